"""Transcript, text and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast import fixed_values as fv
from hindcast.functions import text as tx
from hindcast.functions import urls
from hindcast.operators import manifest, metrics, publish, resolve, transcripts
from hindcast.plans.registry import query
from hindcast.plans.views import view

# the checking engine has no look-around: boundaries consume a character instead
_W = r"\p{L}\p{N}_"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _lines(text: str) -> str:
    """Line list of a text, without the empty piece after a final break."""
    parts = f"string_split_regex({text}, '{_BREAK}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'))"


def _search(text: str) -> str:
    return _collapse(f"lower(replace({text}, chr(8204), ' '))")


def _quoted(word: str) -> str:
    return tx.python_search_text(word).replace("&", r"\&").replace("'", "''")


def _keywords(words: list[str]) -> str:
    return rf"(^|[^{_W}])(" + "|".join(_quoted(w) for w in words) + rf")($|[^{_W}])"


@query(
    "search_text", f"SELECT doc_id, {_search('text')} AS normalized FROM {{documents}}"
)
def search_text_query(spark, sf):
    return view(spark, sf, "documents").select("doc_id", tx.search_text(F.col("text")).alias("normalized"))


@query(
    "number_lines",
    f"""SELECT video_id, CAST(line AS INTEGER) AS line, printf('L%04d: %s', line, parts[line]) AS labelled FROM (
      SELECT video_id, parts, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT video_id, {_lines('transcript')} AS parts FROM {{transcripts}}))""",
)
def number_lines_query(spark, sf):
    return transcripts.number_lines(view(spark, sf, "transcripts"), "video_id", "transcript")


SLICE_CTE = f"""
cited AS (
  SELECT *, len(parts) AS n, CASE WHEN source_line_start <= source_line_end AND source_line_end <= len(parts)
    THEN array_to_string(parts[source_line_start:source_line_end], chr(10)) END AS selected
  FROM (SELECT *, {_lines('transcript')} AS parts FROM {{text_claims}})),
sliced AS (
  SELECT *, CASE WHEN source_line_end < source_line_start THEN 'reversed_line_range' WHEN source_line_end > n THEN 'line_outside_transcript'
    WHEN source_line_end - source_line_start + 1 > 8 THEN 'too_many_lines' WHEN length(selected) > 2000 THEN 'evidence_too_long' END AS range_violation FROM cited)"""


@query("evidence_slice", f"WITH {SLICE_CTE} SELECT claim_id, range_violation, selected FROM sliced")
def evidence_slice_query(spark, sf):
    return transcripts.evidence_slice(view(spark, sf, "text_claims")).select("claim_id", "range_violation", "selected")


_TOKENS = rf"'[{_W}\x{{600}}-\x{{6ff}}]+'"
_UNLABEL = rf"regexp_replace(source_excerpt, '(?m)^{_SPACE}*L\d{{4}}:{_SPACE}*', '', 'g')"
_EVIDENCE = lambda text: _collapse(f"replace({text}, chr(8204), ' ')")
COVERAGE_CTE = SLICE_CTE + f""",
left_tokens AS (SELECT claim_id, token, count(*) AS n FROM (
  SELECT claim_id, unnest(regexp_extract_all(lower({_EVIDENCE(_UNLABEL)}), {_TOKENS})) AS token FROM sliced WHERE selected IS NOT NULL) GROUP BY ALL),
right_tokens AS (SELECT claim_id, token, count(*) AS n FROM (
  SELECT claim_id, unnest(regexp_extract_all(lower({_EVIDENCE('selected')}), {_TOKENS})) AS token FROM sliced WHERE selected IS NOT NULL) GROUP BY ALL),
sizes AS (SELECT s.claim_id, (SELECT sum(n) FROM left_tokens l WHERE l.claim_id = s.claim_id) AS l, (SELECT sum(n) FROM right_tokens r WHERE r.claim_id = s.claim_id) AS r FROM sliced s),
common AS (SELECT l.claim_id, sum(least(l.n, r.n)) AS n FROM left_tokens l JOIN right_tokens r ON r.claim_id = l.claim_id AND r.token = l.token GROUP BY 1),
bound AS (
  SELECT s.*, CASE WHEN selected IS NOT NULL THEN contains({_EVIDENCE('selected')}, {_EVIDENCE(_UNLABEL)}) END AS exact_match,
    CASE WHEN selected IS NOT NULL THEN coalesce(CAST(c.n AS DOUBLE) / CAST(least(z.l, z.r) AS DOUBLE), 0) END AS coverage
  FROM sliced s LEFT JOIN sizes z ON z.claim_id = s.claim_id LEFT JOIN common c ON c.claim_id = s.claim_id)"""


@query(
    "evidence_coverage",
    f"""WITH {COVERAGE_CTE} SELECT claim_id, exact_match, coverage,
      CASE WHEN NOT exact_match AND coverage < CAST(0.72 AS DOUBLE) THEN 'excerpt_mismatch' END AS excerpt_violation FROM bound""",
)
def evidence_coverage_query(spark, sf):
    return transcripts.evidence_coverage(view(spark, sf, "text_claims")).select("claim_id", "exact_match", "coverage", "excerpt_violation")


def _numbers(text: str) -> str:
    """Distinct canonical numbers of a text. A mark after every character between words stands in for look-behind."""
    plain = f"translate({text}, '{fv.DIGITS_FROM}', '{fv.DIGITS_TO}')"
    marked = f"regexp_replace({plain}, '([^{_W}])', '\\1' || chr(1), 'g')"
    number = rf"(?:^|\x01)((?:[-+]\x01)?(?:\d{{1,3}}(?:[,٬]\x01\d{{3}})+|\d+)(?:[.٫]\x01\d+)?)(?:$|[^{_W}])"
    bare = "regexp_replace(translate(m, '٫,٬+' || chr(1), '.'), '^(-?)0+(\\d)', '\\1\\2')"
    trimmed = f"CASE WHEN contains({bare}, '.') THEN regexp_replace({bare}, '\\.?0+$', '') ELSE {bare} END"
    return f"list_distinct([{trimmed} for m in regexp_extract_all({marked}, '{number}', 1)])"


@query("numeric_tokens", f"SELECT doc_id, unnest({_numbers('transcript')}) AS number FROM {{transcripts}}")
def numeric_tokens_query(spark, sf):
    found = F.explode_outer(tx.numeric_tokens(F.col("transcript"))).alias("number")
    return view(spark, sf, "transcripts").select("doc_id", found).filter("number IS NOT NULL")


def _binding(level: str) -> str:
    own = _numbers(level)
    return f"""CASE WHEN len({own}) = 0 THEN 'non_numeric_level' WHEN regexp_matches({level}, '(?i){fv.NON_PRICE_LEVEL}') THEN 'duration_or_percentage_level'
      WHEN len(list_filter({own}, lambda n: NOT list_contains(present, n))) > 0 THEN 'level_not_in_evidence' END"""


@query(
    "level_binding",
    f"""WITH {SLICE_CTE} SELECT claim_id, concat_ws(',', {_binding('level_a')}, {_binding('level_b')}) AS level_violations
      FROM (SELECT *, CASE WHEN selected IS NULL THEN [] ELSE {_numbers('selected')} END AS present FROM sliced)""",
)
def level_binding_query(spark, sf):
    claims = view(spark, sf, "text_claims").withColumn("levels", F.array("level_a", "level_b"))
    sliced = transcripts.evidence_slice(claims)
    return transcripts.level_binding(sliced).select("claim_id", F.array_join("level_violations", ",").alias("level_violations"))


@query(
    "level_numbers",
    """SELECT claim_id, CAST(pos AS INTEGER) AS pos, CAST(number AS DOUBLE) AS number FROM (
      SELECT claim_id, unnest(numbers) AS number, unnest(range(0, len(numbers))) AS pos FROM (
        SELECT claim_id, CASE claim_id % 5 WHEN 0 THEN [63500.0] WHEN 1 THEN [63500.0] WHEN 2 THEN [claim_id + 0.5] ELSE [] END
          || CASE WHEN claim_id % 3 = 0 THEN [1234.5] WHEN claim_id % 3 = 2 THEN [64000.0] ELSE [] END AS numbers FROM {text_claims}))""",
)
def level_numbers_query(spark, sf):
    levels = tx.level_numbers(F.array("level_a", "level_b"))
    return view(spark, sf, "text_claims").select("claim_id", F.posexplode(levels).alias("pos", "number"))


def _horizon_sql() -> str:
    digit, word = r"[^\p{Nd}]", rf"[^{_W}]"
    units = {24: ("24", "1"), 48: ("48", "2")}
    tails = {
        24: rf"(^|{word})(today|tomorrow|daily|intraday|one[ -]day|next\s+(?:trading\s+)?day|same\s+day)($|{word})|امروز|فردا|روزانه|درون\s*روزی|یک\s*روز|يوم\s*واحد",
        48: rf"(^|{word})(two[ -]days?|next\s+two\s+days)($|{word})|دو\s*روز|پس\s*فردا|يومين",
    }
    test = {
        h: rf"(^|{digit}){a}\s*(?:h(?:ours?)?|hrs?|ساعت|ساعة)($|{word})|(^|{digit}){b}\s*(?:d(?:ays?)?|روز(?:ه)?|يوم)($|{word})|{tails[h]}"
        for h, (a, b) in units.items()
    }
    return f"""WITH t AS (SELECT claim_id, lower({_EVIDENCE(f"translate(time_horizon, '{fv.DIGITS_FROM}', '{fv.DIGITS_TO}')")}) AS h FROM {{claims}}),
      m AS (SELECT claim_id, regexp_matches(h, '{test[24]}') AS m24, regexp_matches(h, '{test[48]}') AS m48,
        regexp_matches(h, '(^|{digit})24\\s*(?:-|–|—|to|تا)\\s*48($|{digit})') AS ranged FROM t)
      SELECT claim_id, CAST(CASE WHEN ranged OR m24 = m48 THEN NULL WHEN m24 THEN 24 WHEN m48 THEN 48 END AS INTEGER) AS hours FROM m"""


@query("normalize_horizon", _horizon_sql())
def normalize_horizon_query(spark, sf):
    return view(spark, sf, "claims").select("claim_id", tx.normalize_horizon(F.col("time_horizon")).alias("hours"))


_INSTRUCTION = fv.INSTRUCTION_LIKE


@query("instruction_flag", f"SELECT doc_id, regexp_matches(transcript, '{_INSTRUCTION}', 'i') AS flagged FROM {{transcripts}}")
def instruction_flag_query(spark, sf):
    return view(spark, sf, "transcripts").select("doc_id", tx.instruction_like(F.col("transcript")).alias("flagged"))


def _category_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({_search(text)}, '{_keywords(words)}') THEN '{category}'" for category, words in fv.CATEGORY_RULES.items()
    )
    return f"CASE {cases} END"


@query(
    "classify_category",
    f"""SELECT doc_id, coalesce(nullif(audit_category, ''), CASE WHEN doc_id % 31 = 0 THEN 'override_desk' END, {_category_sql('title')}, {_category_sql('description')}, 'unknown') AS category
      FROM {{videos}}""",
)
def classify_category_query(spark, sf):
    videos = view(spark, sf, "videos").drop("category")
    known = F.when(F.col("doc_id") % 31 == 0, F.col("video_id")).otherwise(F.concat(F.lit("other-"), "video_id"))
    overrides = videos.select(known.alias("video_id"), F.lit("override_desk").alias("category"))
    return resolve.classify_category(videos, overrides).select("doc_id", "category")


def _keyword_rows() -> str:
    rows = [
        f"({order}, '{category}', '{word}', '{_keywords([word])}')"
        for order, (category, words) in enumerate(fv.CATEGORY_RULES.items())
        for word in words
    ]
    return ", ".join(rows)


_KEYWORD_CHECK = f"""SELECT t.doc_id, CAST(k.rule_order AS INTEGER) AS rule_order, k.category, k.keyword
      FROM (SELECT doc_id, {_search("title || ' ' || description")} AS normalized FROM {{videos}}) t
      JOIN (VALUES {_keyword_rows()}) AS k(rule_order, category, keyword, pattern) ON regexp_matches(t.normalized, k.pattern)"""


@query("keyword_theta_join", _KEYWORD_CHECK)
def keyword_theta_join_query(spark, sf):
    texts = view(spark, sf, "videos").select("doc_id", F.concat_ws(" ", "title", "description").alias("body"))
    return resolve.keyword_theta_join(texts, "body", resolve.merge_rules(), ["doc_id"])


@query("keyword_dictionary_join", _KEYWORD_CHECK)
def keyword_dictionary_join_query(spark, sf):
    """The same matches from the table of keywords."""
    texts = view(spark, sf, "videos").select("doc_id", F.concat_ws(" ", "title", "description").alias("body"))
    return resolve.keyword_dictionary_join(texts, "body", resolve.merge_rules(), ["doc_id"])


REVIEW_CTE = SLICE_CTE + f""",
reviewed AS (
  SELECT *, CASE WHEN time_horizon = '۲۴ ساعت' THEN 24 WHEN time_horizon = 'two days' THEN 48 END AS hours,
    coalesce(regexp_matches(selected, '{_INSTRUCTION}', 'i'), FALSE) AS odd, coalesce(time_horizon = 'next week', FALSE) AS unsupported FROM sliced)"""


@query(
    "review_policy",
    f"""WITH {REVIEW_CTE} SELECT claim_id, hours AS normalized_horizon_hours, CASE WHEN unsupported THEN 'not_scoreable' ELSE scoreability END AS scoreability,
      'ai_semantic_interpretation' || CASE WHEN odd THEN ',instruction_like_source_text' ELSE '' END || CASE WHEN unsupported THEN ',unsupported_time_horizon' ELSE '' END AS review_flags,
      CASE WHEN unsupported THEN '{fv.UNSUPPORTED_HORIZON_REASON}' ELSE not_scoreable_reason END AS not_scoreable_reason FROM reviewed""",
)
def review_policy_query(spark, sf):
    return transcripts.review_policy(transcripts.evidence_slice(view(spark, sf, "text_claims"))).select(
        "claim_id", "normalized_horizon_hours", "scoreability", F.array_join("review_flags", ",").alias("review_flags"), "not_scoreable_reason"
    )


@query(
    "review_flag_counts",
    f"""WITH {REVIEW_CTE} SELECT scoreability, flag, count(*) AS n FROM (
      SELECT CASE WHEN unsupported THEN 'not_scoreable' ELSE scoreability END AS scoreability, unnest(['ai_semantic_interpretation'] || CASE WHEN odd THEN ['instruction_like_source_text'] ELSE [] END
        || CASE WHEN unsupported THEN ['unsupported_time_horizon'] ELSE [] END) AS flag FROM reviewed) GROUP BY ALL""",
)
def review_flag_counts_query(spark, sf):
    reviewed = transcripts.review_policy(transcripts.evidence_slice(view(spark, sf, "text_claims")))
    return metrics.review_flag_counts(reviewed, ["scoreability"])


@query(
    "claim_logic_check",
    """SELECT claim_id, concat_ws(',', CASE WHEN scoreability = 'not_scoreable' AND not_scoreable_reason IS NULL THEN 'not_scoreable_without_reason' END,
      CASE WHEN scoreability <> 'not_scoreable' AND claim_type = 'not_scoreable' THEN 'contradictory_scoreability' END,
      CASE WHEN scoreability = 'conditional_scoreable' AND coalesce(trim(condition), '') = '' THEN 'conditional_without_condition' END) AS logic_violations FROM {text_claims}""",
)
def claim_logic_check_query(spark, sf):
    return transcripts.claim_logic_check(view(spark, sf, "text_claims")).select(
        "claim_id", F.concat_ws(",", "logic_violations").alias("logic_violations")
    )


# --- captions ----------------------------------------------------------------------------------

_TIME = r"(?:\p{Nd}{1,2}:)?\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{3}"
_CUE = rf"^\s*({_TIME})\s*-->\s*({_TIME})(?:\s+.*)?$"
_STRIPPED = rf"regexp_replace(regexp_replace(raw, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _seconds(text: str) -> str:
    clock = f"string_split(translate({text}, ',{fv.DIGITS_FROM}', '.{fv.DIGITS_TO}'), ':')"
    return f"round(CASE WHEN len({clock}) = 3 THEN CAST({clock}[1] AS DOUBLE) * 3600 ELSE 0 END + CAST({clock}[-2] AS DOUBLE) * 60 + CAST({clock}[-1] AS DOUBLE), 3)"


_CLEAN = _collapse(r"regexp_replace(regexp_replace(line_text, '<[^>]+>', '', 'g'), '\{\\.*?\}', '', 'g')").replace("{\\", "{\\")
CAPTION_CTE = rf"""
pieces AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(0, len(parts))) AS pos FROM (SELECT doc_id, LINES_OF_TEXT AS parts FROM {{captions}})),
marked AS (SELECT doc_id, pos, line_text, regexp_matches(line_text, 'CUE_PATTERN') AS is_cue FROM (SELECT doc_id, pos, STRIPPED_RAW AS line_text FROM pieces)),
timed_docs AS (SELECT doc_id, bool_or(is_cue) AS timed FROM marked GROUP BY 1),
stamped AS (
  SELECT m.doc_id, m.pos, m.line_text, m.is_cue, t.timed, CASE WHEN is_cue THEN SECONDS_1 END AS cue_start,
    CASE WHEN is_cue THEN greatest(SECONDS_1, SECONDS_2) END AS cue_end,
    count(*) FILTER (WHERE is_cue OR (line_text = '' AND t.timed)) OVER (PARTITION BY m.doc_id ORDER BY pos) AS island
  FROM marked m JOIN timed_docs t ON t.doc_id = m.doc_id),
carried AS (SELECT *, max(cue_start) OVER (PARTITION BY doc_id, island) AS active_start, max(cue_end) OVER (PARTITION BY doc_id, island) AS active_end FROM stamped),
spoken AS (
  SELECT *, CLEAN_LINE AS clean FROM carried WHERE NOT is_cue AND line_text <> '' AND NOT regexp_matches(line_text, '^\d+$')
    AND NOT regexp_matches(upper(line_text), '^(WEBVTT|NOTE|STYLE|REGION)') AND (NOT timed OR active_start IS NOT NULL)),
edges AS (SELECT *, CASE WHEN clean = lag(clean) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM spoken WHERE clean <> ''),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges)""".replace(
    "LINES_OF_TEXT", _lines("text")
).replace("CUE_PATTERN", _CUE.replace("{", "{").replace("}", "}")).replace("STRIPPED_RAW", _STRIPPED).replace(
    "SECONDS_1", _seconds(f"regexp_extract(line_text, '{_CUE}', 1)")
).replace("SECONDS_2", _seconds(f"regexp_extract(line_text, '{_CUE}', 2)")).replace("CLEAN_LINE", _CLEAN)


@query("parse_cue_time", f"WITH {CAPTION_CTE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, cue_start, cue_end FROM stamped WHERE is_cue")
def parse_cue_time_query(spark, sf):
    lines = transcripts.caption_lines(view(spark, sf, "captions"), "doc_id")
    return lines.filter("is_cue").select("doc_id", "pos", "cue_start", "cue_end")


@query("last_value_fill", f"WITH {CAPTION_CTE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, active_start, active_end FROM carried")
def last_value_fill_query(spark, sf):
    carried = transcripts.carry_cues(transcripts.caption_lines(view(spark, sf, "captions"), "doc_id"), "doc_id")
    return carried.select("doc_id", "pos", "active_start", "active_end")


@query("clean_caption", f"WITH {CAPTION_CTE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_CLEAN} AS clean FROM marked")
def clean_caption_query(spark, sf):
    lines = transcripts.caption_lines(view(spark, sf, "captions"), "doc_id")
    return lines.select("doc_id", "pos", tx.clean_caption(F.col("line_text")).alias("clean"))


@query(
    "consecutive_dedupe",
    """SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (
      SELECT user_id, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM {events})""",
)
def consecutive_dedupe_query(spark, sf):
    block = F.floor(F.col("event_id") / 4096)
    rows = transcripts.consecutive_dedupe(view(spark, sf, "events"), ["user_id"], "event_id", "event_type", block)
    return rows.select("user_id", "event_id", "run")


@query(
    "canonicalize_subtitle",
    f"""WITH {CAPTION_CTE} SELECT doc_id, CAST(run AS INTEGER) AS line, any_value(clean) AS text, arg_min(active_start, pos) AS start_seconds,
      max(active_end) AS end_seconds FROM runs GROUP BY doc_id, run""",
)
def canonicalize_subtitle_query(spark, sf):
    return transcripts.canonicalize_subtitle(view(spark, sf, "captions"), "doc_id")


@query(
    "transcript_text",
    f"""WITH {CAPTION_CTE}, canonical AS (SELECT doc_id, run, any_value(clean) AS text FROM runs GROUP BY doc_id, run)
      SELECT doc_id, length(string_agg(text, chr(10) ORDER BY run)) AS char_count, CAST(count(*) AS INTEGER) AS line_count,
        sha256(string_agg(text, chr(10) ORDER BY run)) AS transcript_sha256 FROM canonical GROUP BY doc_id""",
)
def transcript_text_query(spark, sf):
    lines = transcripts.canonicalize_subtitle(view(spark, sf, "captions"), "doc_id")
    return transcripts.transcript_text(lines, "doc_id").drop("transcript")


SEGMENT_CTE = """
segs AS (SELECT CASE WHEN conv_id % 5 = 0 THEN -1 - conv_id ELSE conv_id END AS conv_id, turn AS seq, CAST(turn AS DOUBLE) * 7.25 + 0.125 AS s, CASE WHEN turn % 3 = 1 THEN NULL ELSE CAST(turn AS DOUBLE) * 7.25 + 2.5 END AS e,
  CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END AS text FROM {conversations}),
moved AS (SELECT conv_id, seq, s + 600 AS s, greatest(coalesce(e, s) + 600, s + 600 + CAST(0.001 AS DOUBLE)) AS e, text FROM segs WHERE conv_id IN (SELECT conv_id FROM {conversations})
  UNION ALL SELECT conv_id, 0, 600, 600 + CAST(25.0 AS DOUBLE), text FROM (
    SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM {conversations} WHERE conv_id NOT IN (SELECT conv_id FROM segs) GROUP BY 1))"""


def _segment_frames(spark, sf):
    """Turns as segments; those of every fifth conversation belong to unknown chunks."""
    turns = view(spark, sf, "conversations")
    at = F.col("turn").cast("double") * 7.25
    i = F.col("conv_id")
    segments = turns.select(
        F.when(i % 5 == 0, -1 - i).otherwise(i).alias("conv_id"), F.col("turn").alias("seq"), (at + 0.125).alias("start"),
        F.when(F.col("turn") % 3 != 1, at + 2.5).alias("end"),
        F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("text")).alias("text"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), " ")
    chunks = turns.groupBy("conv_id").agg(whole.alias("text")).withColumns({"offset": F.lit(600.0), "duration": F.lit(25.0)})
    return segments, chunks


@query("segment_offsets", f"WITH {SEGMENT_CTE} SELECT conv_id, seq, s AS start, e AS \"end\", text FROM moved")
def segment_offsets_query(spark, sf):
    segments, chunks = _segment_frames(spark, sf)
    return transcripts.segment_offsets(segments, chunks, ["conv_id"])


def _stamp(value: str) -> str:
    ms = f"CAST(round({value} * 1000) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(
    "segments_to_srt",
    f"""WITH {SEGMENT_CTE} SELECT conv_id, string_agg((seq + 1) || chr(10) || {_stamp('s')} || ' --> ' || {_stamp('e')} || chr(10) || {_collapse('text')}, chr(10) || chr(10) ORDER BY seq) || chr(10) AS srt
      FROM moved WHERE {_collapse('text')} <> '' GROUP BY conv_id""",
)
def segments_to_srt_query(spark, sf):
    segments, chunks = _segment_frames(spark, sf)
    return transcripts.segments_to_srt(transcripts.segment_offsets(segments, chunks, ["conv_id"]), "conv_id")


# --- manifest -----------------------------------------------------------------------------------

_FILES = """SELECT video_id, CASE WHEN (doc_id + step) % step = 0 THEN name ELSE name || '.part' END AS name FROM (SELECT video_id, doc_id, unnest(['x.en.srt', 'x.FR.vtt', 'x.provided.fr.txt', 'x.txt', 'x.en.vtt', 'x.de.srt', 'x.aa.srt']) AS name,
  unnest([1, 2, 3, 5, 7, 4, 6]) AS step FROM {videos})"""


@query(
    "pick_track",
    f"""WITH files AS ({_FILES}), scored AS (SELECT *, CASE WHEN lower(name) LIKE '%.en.%' THEN 200 WHEN lower(name) LIKE '%.fr.%' THEN 100 ELSE 0 END
        + CASE WHEN lower(name) LIKE '%.srt' THEN 20 ELSE 0 END AS track_score FROM files
        WHERE lower(name) LIKE '%.srt' OR lower(name) LIKE '%.vtt' OR (lower(name) LIKE '%.provided.%' AND lower(name) LIKE '%.txt')),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY track_score DESC, name) AS rn FROM scored)
      SELECT video_id, name, track_score FROM ranked WHERE rn = 1""",
)
def pick_track_query(spark, sf):
    names = [("x.en.srt", 1), ("x.FR.vtt", 2), ("x.provided.fr.txt", 3), ("x.txt", 5), ("x.en.vtt", 7), ("x.de.srt", 4), ("x.aa.srt", 6)]
    listed = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("step")) for n, s in names]))
    files = view(spark, sf, "videos").select("video_id", "doc_id", listed)
    whole = (F.col("doc_id") + F.col("step")) % F.col("step") == 0
    files = files.withColumn("name", F.when(whole, F.col("name")).otherwise(F.concat("name", F.lit(".part"))))
    return transcripts.pick_track(files.select("video_id", "name"), ["en", "fr"])


@query(
    "subtitle_provenance",
    """SELECT video_id, CASE WHEN subtitle_file LIKE '%.en.%' OR subtitle_file LIKE '%.EN.%' THEN 'en' WHEN subtitle_file LIKE '%.fr.%' THEN 'fr' END AS subtitle_language,
      CASE WHEN subtitle_file IS NULL THEN NULL WHEN subtitle_file LIKE '%.ai.%' THEN 'openai_audio_transcription' WHEN subtitle_file LIKE '%.provided.%' THEN 'operator_provided_transcript'
        WHEN subtitle_file LIKE '%.EN.%' AND lang IN ('en', 'fr') THEN 'youtube_manual_subtitle' ELSE 'youtube_automatic_caption' END AS subtitle_provenance FROM {videos}""",
)
def subtitle_provenance_query(spark, sf):
    videos = view(spark, sf, "videos").withColumn(
        "manual_tracks", F.when(F.col("lang").isin("en", "fr"), F.array(F.lit("en"), F.lit("es")))
    )
    return manifest.subtitle_provenance(videos, ["en", "fr"]).select("video_id", "subtitle_language", "subtitle_provenance")


@query(
    "published_at",
    """SELECT video_id, CASE WHEN stamp IS NOT NULL THEN make_timestamp(stamp * 1000000) WHEN length(upload_date_raw) = 8 THEN
        CAST(substr(upload_date_raw, 1, 4) || '-' || substr(upload_date_raw, 5, 2) || '-' || substr(upload_date_raw, 7, 2) || ' 12:00:00' AS TIMESTAMP) END AS published_at,
      CASE WHEN provided_source THEN 'operator_provided_timestamp' WHEN stamp IS NOT NULL THEN 'youtube_timestamp' ELSE 'date_noon_fallback' END AS published_at_source
      FROM (SELECT *, coalesce(nullif(release_timestamp, 0), nullif(timestamp, 0)) AS stamp FROM {videos})""",
)
def published_at_query(spark, sf):
    return manifest.published_at(view(spark, sf, "videos")).select("video_id", "published_at", "published_at_source")


ELIGIBLE_CTE = """
eligible AS (
  SELECT *, has_subtitle AND clean_text <> '' AS audit_eligible, CASE WHEN has_subtitle AND clean_text = '' THEN 'empty_transcript'
    WHEN NOT has_subtitle THEN 'missing_subtitle' END AS exclusion_reason FROM {videos})"""


@query("eligibility", f"WITH {ELIGIBLE_CTE} SELECT video_id, audit_eligible, exclusion_reason FROM eligible")
def eligibility_query(spark, sf):
    return manifest.eligibility(view(spark, sf, "videos")).select("video_id", "audit_eligible", "exclusion_reason")


@query(
    "manifest_summary",
    f"""WITH {ELIGIBLE_CTE} SELECT channel_key, count(*) AS total_videos_found, count(*) FILTER (WHERE audit_eligible) AS videos_included,
      count(*) FILTER (WHERE NOT audit_eligible) AS videos_automatically_excluded, count(*) FILTER (WHERE audit_eligible AND has_subtitle) AS videos_with_subtitles,
      count(*) FILTER (WHERE audit_eligible AND NOT has_subtitle) AS videos_without_subtitles, count(*) FILTER (WHERE NOT has_subtitle) AS missing_subtitles_found,
      count(*) FILTER (WHERE category = 'unknown') AS unknown_category_count FROM eligible GROUP BY 1""",
)
def manifest_summary_query(spark, sf):
    return manifest.manifest_summary(manifest.eligibility(view(spark, sf, "videos")), ["channel_key"])


@query(
    "manifest_breakdown",
    f"""WITH {ELIGIBLE_CTE}, facets AS (
      SELECT channel_key, 'category' AS facet, category AS value, audit_eligible FROM eligible
      UNION ALL SELECT channel_key, 'date', upload_date_raw, audit_eligible FROM eligible
      UNION ALL SELECT channel_key, 'provenance', coalesce(subtitle_file, 'missing'), audit_eligible FROM eligible)
      SELECT channel_key, facet, value, count(*) FILTER (WHERE audit_eligible) AS included, count(*) AS found FROM facets GROUP BY ALL""",
)
def manifest_breakdown_query(spark, sf):
    videos = manifest.eligibility(view(spark, sf, "videos")).withColumns(
        {"upload_date": F.col("upload_date_raw"), "subtitle_provenance": F.col("subtitle_file")}
    )
    return manifest.manifest_breakdown(videos, ["channel_key"])


@query(
    "scope_summary",
    f"""WITH {ELIGIBLE_CTE}, s AS (SELECT *, category IN ('crypto', 'global_markets') AS inside FROM eligible)
      SELECT channel_key, count(*) AS source_videos_found, count(*) FILTER (WHERE inside) AS videos_in_scope_found, count(*) FILTER (WHERE inside AND audit_eligible) AS videos_audited,
        count(*) FILTER (WHERE inside AND NOT audit_eligible) AS automatic_exclusions, count(*) FILTER (WHERE NOT inside) AS out_of_scope_videos,
        coalesce(string_agg(DISTINCT CASE WHEN NOT inside THEN category END, ',' ORDER BY CASE WHEN NOT inside THEN category END), '') AS out_of_scope_categories FROM s GROUP BY 1""",
)
def scope_summary_query(spark, sf):
    videos = manifest.eligibility(view(spark, sf, "videos"))
    return manifest.scope_summary(videos, ["channel_key"], ["crypto", "global_markets"]).withColumn(
        "out_of_scope_categories", F.array_join("out_of_scope_categories", ",")
    )


@query("channel_mismatch", "SELECT video_id, channel_id, channel_key FROM {videos} WHERE channel_id IS NULL OR channel_id <> CASE WHEN lang = 'de' THEN 'src1' ELSE channel_key END")
def channel_mismatch_query(spark, sf):
    expected = F.when(F.col("lang") == "de", "src1").otherwise(F.col("channel_key"))
    return manifest.channel_mismatch(view(spark, sf, "videos"), expected).select("video_id", "channel_id", "channel_key")


@query("filter_date_range", "SELECT video_id, upload_date_raw FROM {videos} WHERE length(upload_date_raw) = 8 AND upload_date_raw BETWEEN '20240105' AND '20240120'")
def filter_date_range_query(spark, sf):
    inside = manifest.in_date_range(F.col("upload_date_raw"), "20240105", "20240120")
    return view(spark, sf, "videos").filter(inside).select("video_id", "upload_date_raw")


@query(
    "filter_requested_ids",
    """SELECT video_id, 'kept' AS side FROM {videos} WHERE doc_id IN (SELECT doc_id FROM {labels})
      UNION ALL SELECT 'doc-' || (-1 - doc_id), 'unknown' FROM {labels} WHERE quality = 0""",
)
def filter_requested_ids_query(spark, sf):
    labels = view(spark, sf, "labels")
    wanted = labels.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("video_id"))
    strange = labels.filter("quality = 0").select(F.concat(F.lit("doc-"), (-1 - F.col("doc_id")).cast("string")).alias("video_id"))
    kept, unknown = manifest.filter_requested_ids(view(spark, sf, "videos"), wanted.unionByName(strange))
    return kept.select("video_id", F.lit("kept").alias("side")).unionByName(unknown.withColumn("side", F.lit("unknown")))


@query("limit_videos", "SELECT video_id, upload_date_raw AS upload_date, category, title FROM {videos} ORDER BY upload_date_raw NULLS FIRST, category, title, video_id LIMIT 25")
def limit_videos_query(spark, sf):
    videos = view(spark, sf, "videos").withColumn("upload_date", F.col("upload_date_raw"))
    return manifest.limit_videos(videos, 25).select("video_id", "upload_date", "category", "title")


@query(
    "sort_manifest",
    "SELECT video_id, upload_date_raw AS upload_date, category, title FROM {videos} ORDER BY coalesce(upload_date_raw, ''), category, title, video_id",
)
def sort_manifest_query(spark, sf):
    videos = view(spark, sf, "videos").withColumn("upload_date", F.col("upload_date_raw"))
    return metrics.sort_manifest(videos).select("video_id", "upload_date", "category", "title")


@query(
    "compact_to_iso",
    """SELECT video_id, CASE WHEN length(upload_date_raw) = 8 THEN substr(upload_date_raw, 1, 4) || '-' || substr(upload_date_raw, 5, 2) || '-' || substr(upload_date_raw, 7, 2) END AS iso FROM {videos}""",
)
def compact_to_iso_query(spark, sf):
    return view(spark, sf, "videos").select("video_id", tx.compact_to_iso(F.col("upload_date_raw")).alias("iso"))


@query(
    "ids_safe",
    """SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_full_match(c_name, '[A-Za-z0-9_-]{{3,64}}') THEN 'c_name' END,
      CASE WHEN NOT regexp_full_match(segment, '[a-z][a-z0-9_]{{1,63}}') THEN 'segment' END,
      CASE WHEN NOT regexp_full_match(c_mktsegment, '[A-Z0-9]{{5,20}}') THEN 'c_mktsegment' END,
      CASE WHEN NOT regexp_full_match(series_key, '[A-Za-z0-9][A-Za-z0-9^=._-]{{0,63}}') THEN 'series_key' END) AS unsafe
      FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN '^' ELSE '' END || c_mktsegment || '=F' AS series_key FROM {customer})""".replace("{{", "{").replace("}}", "}"),
)
def ids_safe_query(spark, sf):
    segment = F.col("c_mktsegment")
    rows = view(spark, sf, "customer").withColumns(
        {
            "segment": F.when(F.col("c_custkey") % 3 == 0, F.lower(segment)).otherwise(segment),
            "series_key": F.concat(F.when(F.col("c_custkey") % 2 == 0, "^").otherwise(""), segment, F.lit("=F")),
        }
    )
    patterns = {"c_name": fv.VIDEO_ID_PATTERN, "segment": fv.CATEGORY_PATTERN, "c_mktsegment": fv.EXCHANGE_SYMBOL_PATTERN, "series_key": fv.SERIES_KEY_PATTERN}
    return rows.select("c_custkey", F.concat_ws(",", manifest.safe_id_violations(patterns)).alias("unsafe"))


@query(
    "scrape_log_summary",
    """WITH l AS (SELECT *, nullif(regexp_extract(line, '\\[download\\] (\\d+-\\d+-\\d+) upload date is not in range', 1), '') AS day,
        nullif(regexp_extract(line, 'Downloading item (\\d+) of (\\d+)', 1), '') AS i, nullif(regexp_extract(line, 'Downloading item (\\d+) of (\\d+)', 2), '') AS n FROM {log_lines}),
      a AS (SELECT log_id, count(*) FILTER (WHERE line LIKE 'ERROR:%') AS error_count, count(*) FILTER (WHERE line LIKE 'WARNING:%') AS warning_count,
        coalesce(CAST(arg_max(i, line_no) AS INTEGER), 0) AS scanned_items, CAST(arg_max(n, line_no) AS INTEGER) AS reported,
        count(*) FILTER (WHERE day > '2024-01-20') AS rejected_newer_than_end, count(*) FILTER (WHERE day < '2024-01-03') AS rejected_older_than_start FROM l GROUP BY 1)
      SELECT log_id, error_count, warning_count, scanned_items, coalesce(reported, 0) AS reported_playlist_items, rejected_newer_than_end, rejected_older_than_start,
        rejected_older_than_start > 0 AS scan_reached_before_start, coalesce(reported < 220, FALSE) AS playlist_exhausted_before_limit,
        rejected_older_than_start > 0 OR coalesce(reported < 220, FALSE) AS completeness_boundary_confirmed FROM a""",
)
def scrape_log_summary_query(spark, sf):
    return transcripts.scrape_log_summary(view(spark, sf, "log_lines"), "log_id", "2024-01-03", "2024-01-20", 220)


@query(
    "format_evidence_numbers",
    """SELECT event_id, 'return +' || format('{:,.2f}', CAST(CAST(event_id * 37 AS VARCHAR) || '.1236' AS DOUBLE)) || '%, low -' || format('{:,.2f}', CAST(CAST(user_id AS VARCHAR) || '.98765' AS DOUBLE))
      || '; keep 12.5 and v1.2345x' AS shown FROM {events}""",
)
def format_evidence_numbers_query(spark, sf):
    raw = F.concat(
        F.lit("return +"), (F.col("event_id") * 37).cast("string"), F.lit(".1236%, low -"), F.col("user_id").cast("string"),
        F.lit(".98765; keep 12.5 and v1.2345x"),
    )
    return view(spark, sf, "events").select("event_id", tx.format_evidence_numbers(raw).alias("shown"))


# --- addresses and publication -----------------------------------------------------------------------

WATCH_SQL = """(SELECT page_id, 'id_' || page_id AS expected, CASE page_id % 9 WHEN 0 THEN 'https://www.youtube.com/watch?v=id_' || page_id WHEN 1 THEN 'https://m.youtube.com/shorts/id_' || page_id || '/'
  WHEN 2 THEN ' https://youtu.be/id_' || page_id || '?t=3 ' WHEN 3 THEN 'http://youtube.com/watch?v=id_' || page_id WHEN 4 THEN 'https://youtube.com/watch?v=id_' || page_id || '&v=other'
  WHEN 5 THEN 'https://user@youtube.com/watch?v=id_' || page_id WHEN 6 THEN 'https://YouTube.com/live/id_' || page_id WHEN 7 THEN 'https://youtube.com/watch?a=b&v=id_' || page_id || '&c=d' ELSE url END AS address FROM {pages})"""


def _addresses(spark, sf):
    from hindcast.plans.views import references

    text = f"SELECT * FROM {WATCH_SQL}"
    return spark.sql(text, **{n: view(spark, sf, n) for n in references(text)})


@query(
    "canonical_urls",
    f"SELECT page_id, CASE WHEN page_id % 9 IN (0, 1, 2, 6, 7) AND length(expected) > 2 THEN 'https://www.youtube.com/watch?v=' || expected END AS canonical FROM {WATCH_SQL}",
)
def canonical_urls_query(spark, sf):
    return _addresses(spark, sf).select("page_id", urls.canonical_watch_url(F.col("address"), F.col("expected")).alias("canonical"))


@query(
    "canonical_channels",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/@desk' || page_id WHEN 1 THEN 'https://www.youtube.com/channel/UC' || page_id ELSE NULL END AS canonical FROM {pages}""",
)
def canonical_channels_query(spark, sf):
    pid = F.col("page_id").cast("string")
    address = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://youtube.com/@desk"), pid, F.lit("/videos/")))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://M.youtube.com/channel/UC"), pid))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("https://youtube.com/user/a/"), pid))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("https://youtube.com/c/x?y="), pid))
        .otherwise(F.col("url"))
    )
    return view(spark, sf, "pages").select("page_id", urls.canonical_channel_url(address).alias("canonical"))


_ADDRESS = """(SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:p@w:x@') WHEN 2 THEN 'ftp://host/' || page_id ELSE 'HTTPS://Host:8080/p' || page_id || '?q#f' END AS address FROM {pages})"""


@query(
    "sanitize_url",
    f"""SELECT page_id, CASE page_id % 4 WHEN 2 THEN '' WHEN 3 THEN 'https://host:8080/p' || page_id ELSE regexp_replace(replace(address, 'user:p@w:x@', ''), '[?#].*$', '') END AS strict,
      CASE page_id % 4 WHEN 2 THEN address WHEN 3 THEN 'https://host:8080/p' || page_id ELSE regexp_replace(replace(address, 'user:p@w:x@', ''), '[?#].*$', '') END AS lenient FROM {_ADDRESS}""",
)
def sanitize_url_query(spark, sf):
    rows = spark.sql(f"SELECT * FROM {_ADDRESS}", pages=view(spark, sf, "pages"))
    address = F.col("address")
    return rows.select("page_id", urls.sanitize_url(address).alias("strict"), urls.sanitize_url(address, strict=False).alias("lenient"))


@query(
    "redact_text",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<local-path>/page' || page_id || '.html' WHEN 1 THEN '<local-file>' WHEN 2 THEN 'see ' || regexp_replace(url, '[?#].*$', '') || ' and <workspace>/x ' || html
      ELSE regexp_replace(url, '[?#].*$', '') END AS redacted FROM {pages}""",
)
def redact_text_query(spark, sf):
    pid, url = F.col("page_id").cast("string"), F.col("url")
    text = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/srv/data/page"), pid, F.lit(".html")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("file:///tmp/"), pid))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("see "), F.replace(url, F.lit("://"), F.lit("://u:p@ss@")), F.lit(" and /work/audit/x "), F.col("html")))
        .otherwise(url)
    )
    return view(spark, sf, "pages").select("page_id", urls.redact_text(text, workspace="/work/audit/").alias("redacted"))


@query(
    "allowlist_projection",
    "SELECT claim_id, video_id, category, direction, claim_type, condition, invalidation_condition, time_horizon, normalized_horizon_hours, scoreability FROM {claims}",
)
def allowlist_projection_query(spark, sf):
    return publish.allowlist_projection(view(spark, sf, "claims"), publish.PUBLIC_CLAIM)


def _secret_text(spark, sf):
    """Documents; some carry a planted credential after their text."""
    tail = F.concat(F.lit(" sk-"), F.repeat(F.lit("abc4"), 6), F.lit(" ghp_"), F.repeat(F.lit("X9y8"), 6))
    other = F.concat(F.lit(" AIza"), F.repeat(F.lit("q1w2"), 6), F.lit(" -----BEGIN RSA PRIVATE KEY-----"))
    pick = F.when(F.col("doc_id") % 7 == 0, tail).when(F.col("doc_id") % 7 == 1, other).otherwise("")
    return view(spark, sf, "documents").select("doc_id", F.concat("text", pick).alias("body"))


_SECRET_ROWS = ", ".join("('%s', '%s')" % (label, pattern.replace("'", "''")) for label, pattern in fv.SECRET_PATTERNS.items())


@query(
    "secret_scan",
    f"""SELECT d.doc_id, p.label FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' sk-' || repeat('abc4', 6) || ' ghp_' || repeat('X9y8', 6)
        WHEN 1 THEN ' AIza' || repeat('q1w2', 6) || ' -----BEGIN RSA PRIVATE KEY-----' ELSE '' END AS body FROM {{documents}}) d
      JOIN (VALUES {_SECRET_ROWS}) AS p(label, pattern) ON regexp_matches(d.body, p.pattern)""",
)
def secret_scan_query(spark, sf):
    return publish.secret_scan(_secret_text(spark, sf), "doc_id", "body")
