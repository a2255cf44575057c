"""One query per operator over the whole tables, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.clock import anchor_seconds, clock, clock_seconds
from colloquy.functions.text import SPACE, estimated_tokens, filled, full_lines, has_han, has_hangul, has_kana, has_latin, judged, pick_hash, reread_ids, title_of, without_thinking
from colloquy.functions.tokens import token_count
from colloquy.operators import agent, chunks, compact, curate, evaluation, external, gates, normalise, notes, planning, preferences, transcript, vectors, vocabulary
from colloquy.session import durable, scratch
from colloquy.sources import jsonl
from colloquy.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        ALL[f.__name__] = (f, sql)
        return f

    return add


# The white space of functions.text, as RE2 writes it.
SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = lambda x: f"regexp_replace({x}, '^{SP}+|{SP}+\\z', '', 'g')"
LINE1 = lambda x: f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"
WORDS = lambda x: f"(CASE WHEN {LINE1(x)} = '' THEN 0 ELSE len(string_split({LINE1(x)}, ' ')) END)"
FULL = lambda x: f"list_filter(string_split({x}, chr(10)), lambda z: {STRIP('z')} <> '')"
CLOCK = lambda x: f"(CASE WHEN {x} >= 3600 THEN ({x} // 3600) || ':' || lpad(CAST(({x} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0') ELSE ({x} // 60) || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0') END)"

LINES = f"""
    said AS (SELECT row_id, lang, unnest(utterances) AS u, generate_subscripts(utterances, 1) - 1 AS pos FROM meetings),
    flat AS (SELECT row_id, lang, pos, nullif(u.speaker, '') AS speaker, {LINE1("coalesce(u.text, '')")} AS text FROM said),
    firsts AS (SELECT row_id, speaker, min(pos) AS p FROM flat WHERE speaker IS NOT NULL GROUP BY ALL),
    ranks AS (SELECT row_id, speaker, dense_rank() OVER (PARTITION BY row_id ORDER BY p) AS r FROM firsts),
    timed AS (SELECT f.row_id, f.pos, 'S' || r AS label, f.text,
        row_number() OVER w - 1 AS line_no,
        coalesce(sum(CAST(floor(length(f.text) * 1e6::DOUBLE / CASE lang WHEN 'zh-TW' THEN 4.7::DOUBLE ELSE 14.0::DOUBLE END + 1e6::DOUBLE) AS BIGINT)) OVER (PARTITION BY f.row_id ORDER BY f.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000000 AS t
        FROM flat f LEFT JOIN ranks USING (row_id, speaker) WHERE f.text <> '' WINDOW w AS (PARTITION BY f.row_id ORDER BY f.pos)),
    lines AS (SELECT row_id, CAST(line_no AS INT) AS line_no, CAST(floor(t) AS INT) AS start_sec, label, text,
        '[' || {CLOCK("CAST(floor(t) AS INT)")} || '] ' || coalesce(label || ': ', '') || text AS line FROM timed)"""


@query(f"WITH {LINES} SELECT * FROM lines")
def transcript_lines(s, d):
    return transcript.render_lines(table(s, d, "meetings"))


@query(f"WITH {LINES} SELECT row_id, string_agg(line, chr(10) ORDER BY line_no) AS transcript FROM lines GROUP BY row_id")
def transcript_text(s, d):
    return transcript.render_transcripts(table(s, d, "meetings"))


@query(f"""WITH {LINES}, rest AS (SELECT row_id, line_no, line, substr(line, instr(line, '] ') + 2) AS r FROM lines), cut AS (SELECT *, instr(r, ': ') BETWEEN 2 AND 41 AS named FROM rest)
    SELECT row_id, line_no, regexp_extract(line, '^\\[(\\d+:\\d{{2}}(?::\\d{{2}})?)\\] ', 1) AS ts, CASE WHEN named THEN substr(r, 1, instr(r, ': ') - 1) END AS speaker, CASE WHEN named THEN substr(r, instr(r, ': ') + 2) ELSE r END AS text FROM cut""")
def parse_roundtrip(s, d):
    lines = transcript.render_lines(table(s, d, "meetings"))
    return lines.select("row_id", "line_no", transcript.parse_line("line").alias("p")).select("row_id", "line_no", "p.*")


@query(f"WITH {LINES} SELECT row_id, string_agg(CASE WHEN label IS NULL AND instr(text, ': ') BETWEEN 2 AND 41 THEN substr(text, instr(text, ': ') + 2) ELSE text END, chr(10) ORDER BY line_no) AS plain FROM lines GROUP BY row_id")
def strip_tags(s, d):
    return transcript.render_transcripts(table(s, d, "meetings")).select("row_id", transcript.strip_tags("transcript").alias("plain"))


@query("SELECT row_id, len(list_filter(utterances, lambda u: coalesce(u.speaker, '') <> '')) > 0 AS has_speakers FROM meetings")
def speaker_presence(s, d):
    return table(s, d, "meetings").select("row_id", transcript.has_speakers().alias("has_speakers"))


_POOLS = " ".join(f"WHEN '{lang}' THEN {names}" for lang, names in transcript.NAMES.items())


@query(f"""WITH {LINES}, pool AS (SELECT row_id, lang, list_transform(list_sort(list_transform(CASE lang {_POOLS} END, lambda n: {{'h': md5(row_id || '|' || n), 'n': n}})), lambda x: x.n) AS p FROM meetings),
    told AS (SELECT l.row_id, l.line_no, l.start_sec, l.text, CASE WHEN f.speaker IS NOT NULL THEN CASE WHEN regexp_matches(f.speaker, '(?i)^(person|speaker|spk|s)[ _]?\\d+$') THEN coalesce(p.p[k.r], 'S' || k.r) ELSE f.speaker END END AS label
        FROM timed t JOIN lines l ON l.row_id = t.row_id AND l.line_no = t.line_no JOIN flat f ON f.row_id = t.row_id AND f.pos = t.pos LEFT JOIN ranks k ON k.row_id = f.row_id AND k.speaker = f.speaker JOIN pool p ON p.row_id = t.row_id)
    SELECT *, '[' || {CLOCK("start_sec")} || '] ' || coalesce(label || ': ', '') || text AS line FROM told""")
def named_speakers(s, d):
    return transcript.render_lines(table(s, d, "meetings"), "names")


@query("""
    WITH marks AS (SELECT * FROM (VALUES (1, 'Transcript:' || chr(10)), (2, '逐字稿:' || chr(10)), (3, 'Partial summaries:' || chr(10)), (4, '部分摘要:' || chr(10)), (5, 'Summary:' || chr(10)), (6, '摘要:' || chr(10)), (7, 'Items:' || chr(10))) t(n, m)),
    hit AS (SELECT target_id, prompt, min_by(m, n) AS m FROM targets, marks WHERE contains(prompt, m) GROUP BY ALL)
    SELECT t.target_id, CASE WHEN h.m IS NULL THEN t.prompt ELSE string_split(t.prompt, h.m)[-1] END AS transcript FROM targets t LEFT JOIN hit h USING (target_id)""")
def transcript_of_prompt(s, d):
    return table(s, d, "targets").select("target_id", transcript.transcript_of("prompt").alias("transcript"))


# The patterns of operators.compact, operators.gates as RE2 writes them: white space and word ends spelt out.
_END = r"([^\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]|$)"
_BACK = f"(?i)^(uh|um|erm|mm|mhm|hmm|uh-huh|yeah|yep|yes|ok|okay|right|sure|got it|i see|exactly|true)[{SP[1:-1]},.!?]*$"
_BACK_ZH = f"^[嗯欸誒喔噢哦啊呃唉哎呀吧嘛耶阿はい,，。、!！?？~～{SP[1:-1]}]*$|^(對|對對|對對對|好|好的|好好好|是|是的|沒錯|了解|OK|ok)[。，,{SP[1:-1]}!！]*$"


@query(f"""WITH said AS (SELECT row_id, lang, unnest(utterances) AS u, generate_subscripts(utterances, 1) - 1 AS pos FROM meetings), t AS (SELECT row_id, lang, pos, {STRIP("coalesce(u.text, '')")} AS x FROM said)
    SELECT row_id, CAST(pos AS INT) AS pos FROM t WHERE x = '' OR CASE WHEN lang = 'zh-TW' THEN regexp_matches(x, '{_BACK_ZH}') ELSE regexp_matches(x, '{_BACK}') END""")
def backchannel_lines(s, d):
    lines = transcript.utterance_lines(table(s, d, "meetings"))
    chinese = F.coalesce(F.col("lang") == "zh-TW", F.lit(False))
    return lines.filter(F.when(chinese, compact.is_backchannel("text", "zh")).otherwise(compact.is_backchannel("text"))).select("row_id", "pos")


_FILL = r"(?i)\b(you know|i mean|sort of|kind of|like,|um|uh|erm)\b[,]?" + SP + "*"
_FILL_ZH = f"(那個|這個|就是說|然後呢|對不對|你知道嗎)([，,、{SP[1:-1]}])"
_FILLED = f"CASE WHEN lang = 'zh-TW' THEN regexp_replace(x, '{_FILL_ZH}', '\\2', 'g') ELSE regexp_replace(x, '{_FILL}', '', 'g') END"


@query(f"""WITH said AS (SELECT row_id, lang, unnest(utterances) AS u, generate_subscripts(utterances, 1) - 1 AS pos FROM meetings), t AS (SELECT row_id, lang, pos, coalesce(u.text, '') AS x FROM said)
    SELECT row_id, CAST(pos AS INT) AS pos, trim(regexp_replace({_FILLED}, '{SP}{{2,}}', ' ', 'g'), ' ,') AS text FROM t""")
def without_fillers(s, d):
    lines = transcript.utterance_lines(table(s, d, "meetings"))
    chinese = F.coalesce(F.col("lang") == "zh-TW", F.lit(False))
    return lines.select("row_id", "pos", F.when(chinese, compact.without_fillers("text", "zh")).otherwise(compact.without_fillers("text")).alias("text"))


_LINE = r"^\[(\d+:\d{2}(?::\d{2})?)\]" + SP + r"*(?:([^:\n]{1,40}):" + SP + r"*)?(.*)$"


@query(f"""WITH {LINES} SELECT row_id, line_no, regexp_extract(line, '{_LINE}', 1) AS ts, nullif(regexp_extract(line, '{_LINE}', 2), '') AS speaker, regexp_extract(line, '{_LINE}', 3) AS said FROM lines""")
def line_grammar(s, d):
    lines = transcript.render_lines(table(s, d, "meetings"))
    return lines.select("row_id", "line_no", compact.line_parts("line").alias("p")).select("row_id", "line_no", "p.*")


@query(f"""WITH {LINES},
    new AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY row_id ORDER BY line_no) THEN 0 ELSE 1 END AS n FROM lines),
    isl AS (SELECT *, sum(n) OVER (PARTITION BY row_id ORDER BY line_no) - 1 AS island FROM new)
    SELECT row_id, CAST(island AS INT) AS island, min_by({CLOCK("start_sec")}, line_no) AS ts, min_by(label, line_no) AS speaker, string_agg(text, ' ' ORDER BY line_no) AS text FROM isl GROUP BY row_id, island""")
def merge_adjacent_turns(s, d):
    lines = transcript.render_lines(table(s, d, "meetings")).select("row_id", "line_no", clock(F.col("start_sec")).alias("ts"), F.col("label").alias("speaker"), "text")
    return compact.merge_adjacent(lines, "row_id", "line_no")


_WORD = r"[\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"
# Repeats go without back-references: of pieces (words and what stands between) a word that repeats the one before it after a single space, of characters those that make three or more.
_UNSTUTTERED = """CASE WHEN lang = 'zh-TW' THEN array_to_string(list_filter(c, lambda x, i: NOT (i > 1 AND regexp_matches(x, '[一-鿿]') AND c[i - 1] = x AND ((i > 2 AND c[i - 2] = x) OR coalesce(c[i + 1] = x, false)))), '')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT ((i > 2 AND w[i - 1] = ' ' AND lower(w[i - 2]) = lower(x)) OR (i > 1 AND x = ' ' AND coalesce(lower(w[i - 1]) = lower(w[i + 1]), false)))), '') END"""
_COMPACT = f"""{LINES}, g AS (SELECT l.row_id, m.lang, l.line_no, regexp_extract(l.line, '{_LINE}', 1) AS ts, nullif(regexp_extract(l.line, '{_LINE}', 2), '') AS speaker, regexp_extract(l.line, '{_LINE}', 3) AS said FROM lines l JOIN (SELECT row_id, lang FROM meetings) m USING (row_id)),
    told AS (SELECT *, string_split(said, '') AS c, regexp_extract_all(said, '{_WORD}+|[^{_WORD[1:-1]}]+') AS w FROM g WHERE {STRIP("said")} <> '' AND NOT CASE WHEN lang = 'zh-TW' THEN regexp_matches({STRIP("said")}, '{_BACK_ZH}') ELSE regexp_matches({STRIP("said")}, '{_BACK}') END),
    plain AS (SELECT row_id, lang, line_no, ts, speaker, {_UNSTUTTERED} AS x FROM told),
    clean AS (SELECT row_id, lang, line_no, ts, speaker, trim(regexp_replace({_FILLED}, '{SP}{{2,}}', ' ', 'g'), ' ,') AS text FROM plain),
    kept AS (SELECT * FROM clean WHERE text <> '')"""


@query(f"""WITH {_COMPACT}, new AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY row_id ORDER BY line_no) THEN 0 ELSE 1 END AS n FROM kept),
    isl AS (SELECT *, sum(n) OVER (PARTITION BY row_id ORDER BY line_no) AS island FROM new),
    turns AS (SELECT row_id, island, '[' || min_by(ts, line_no) || '] ' || coalesce(any_value(speaker) || ': ', '') || CASE WHEN lang = 'zh-TW' THEN string_agg(text, '' ORDER BY line_no) ELSE string_agg(text, ' ' ORDER BY line_no) END AS line FROM isl GROUP BY row_id, island, lang)
    SELECT row_id, string_agg(line, chr(10) ORDER BY island) AS transcript FROM turns GROUP BY row_id""")
def compacted_transcripts(s, d):
    lines = transcript.render_lines(table(s, d, "meetings"), keep=("lang",))
    return transcript.joined(compact.compact_rendered(lines, lang=F.col("lang")), "row_id", "line_no", "line", "transcript")


@query(f"WITH {_COMPACT} SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY line_no) - 1 AS INT) AS line_no, '[' || ts || '] ' || coalesce(speaker || ': ', '') || text AS line FROM kept")
def compacted_lines_unmerged(s, d):
    return compact.compact_rendered(transcript.render_lines(table(s, d, "meetings"), keep=("lang",)), lang=F.col("lang"), merge=False)


@query("""WITH n AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 3500 THEN 1 ELSE CAST(ceil((length(text) - 300) / 3200.0) AS INT) END)) AS chunk FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(chunk AS INT) AS chunk, substr(text, chunk * 3200 + 1, 3500) AS chunk_text FROM n""")
def chunk_windows(s, d):
    return chunks.windows(table(s, d, "documents").select("doc_id", "text"))


_COST = lambda x: f"CAST(ceil((length({x}) - length(regexp_replace({x}, '[ぁ-ヿ一-鿿]', '', 'g'))) / 1.67::DOUBLE + length(regexp_replace({x}, '[ぁ-ヿ一-鿿]', '', 'g')) / 4.0::DOUBLE) AS INT)"
# Greedy packing of ls (k, i from 0, cost) into groups under a budget: one step of the recursion for each item of the longest list.
_PACKED = lambda budget, between: f"""packed AS (SELECT k, i, 0 AS g, CAST(cost AS BIGINT) AS used FROM ls WHERE i = 0
        UNION ALL SELECT l.k, l.i, CASE WHEN p.used + {between} + l.cost > {budget} THEN p.g + 1 ELSE p.g END, CASE WHEN p.used + {between} + l.cost > {budget} THEN l.cost ELSE p.used + {between} + l.cost END
        FROM packed p JOIN ls l ON l.k = p.k AND l.i = p.i + 1)"""  # noqa: E731


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
    ls AS (SELECT *, {_COST("x")} + 1 AS cost FROM d), {_PACKED(400, 0)}
    SELECT k AS doc_id, CAST(g AS INT) AS chunk, string_agg(x, chr(10) ORDER BY i) AS chunk_text FROM packed JOIN ls USING (k, i) GROUP BY k, g""")
def chunk_greedy_lines(s, d):
    return chunks.line_chunks(table(s, d, "documents").select("doc_id", "text"), budget=400)


@query(f"""WITH RECURSIVE d AS (SELECT row_id AS k, unnest(utterances).text AS x, generate_subscripts(utterances, 1) - 1 AS i FROM meetings),
    ls AS (SELECT k, i, coalesce(x, '') AS x, length(coalesce(x, '')) AS cost FROM d), {_PACKED(1000, 2)}
    SELECT k AS row_id, CAST(g AS INT) AS part, CAST(count(*) AS INT) AS n, string_agg(x, '|' ORDER BY i) AS said FROM packed JOIN ls USING (k, i) GROUP BY k, g""")
def grouped_partials(s, d):
    texts = F.transform("utterances", lambda u: F.coalesce(u["text"], F.lit("")))
    rows = table(s, d, "meetings").select("row_id", F.posexplode(chunks.group_partials(texts, 1000)).alias("part", "g"))
    return rows.select("row_id", "part", F.size("g").alias("n"), F.array_join("g", "|").alias("said"))


@query()
def folded_partials(s, d):
    rows = table(s, d, "meetings").select("row_id", F.transform("utterances", lambda u: F.coalesce(u["text"], F.lit(""))).alias("partials"))
    return chunks.fold_to_fit(rows, "partials", 1000, "\n\n", lambda g: F.left(F.array_join(g, " "), F.lit(200)))


@query("""SELECT target_id, prompt AS transcript, left(completion, 3000) AS output FROM targets""")
def judge_excerpts(s, d):
    return table(s, d, "targets").select("target_id", chunks.judge_excerpt(F.col("prompt"), F.col("completion")).alias("x")).select("target_id", "x.*")


@query("""SELECT target_id, CAST(ceil((length(prompt) - length(regexp_replace(prompt, '[ぁ-ヿ一-鿿]', '', 'g'))) / 1.67::DOUBLE + length(regexp_replace(prompt, '[ぁ-ヿ一-鿿]', '', 'g')) / 4.0::DOUBLE) AS INT) AS ntok,
    ceil((length(prompt) - length(regexp_replace(prompt, '[ぁ-ヿ一-鿿]', '', 'g'))) / 1.67::DOUBLE + length(regexp_replace(prompt, '[ぁ-ヿ一-鿿]', '', 'g')) / 4.0::DOUBLE) + 640 + 96 <= 32768 AS fits FROM targets""")
def token_fit(s, d):
    n = estimated_tokens("prompt")
    return table(s, d, "targets").select("target_id", n.alias("ntok"), chunks.fits(n, F.lit(640)).alias("fits"))


@query("SELECT target_id, CASE WHEN completion IS NOT NULL THEN CAST(greatest(512, least(3500, floor((4096 - 96 - length(completion)) * 3 / 5.0))) AS INT) END AS budget FROM targets")
def map_budgets(s, d):
    return table(s, d, "targets").select("target_id", chunks.map_budget(F.length("completion")).alias("budget"))


@query("""SELECT target_id, regexp_matches(completion, '[ぁ-ゟ゠-ヺー-ヿ]') AS kana, regexp_matches(completion, '[가-힣ᄀ-ᇿ]') AS hangul, regexp_matches(completion, '[一-鿿]') AS han, regexp_matches(lower(completion), '[a-z]') AS latin FROM targets WHERE completion IS NOT NULL""")
def script_profile(s, d):
    rows = table(s, d, "targets").filter("completion is not null")
    return rows.select("target_id", has_kana("completion").alias("kana"), has_hangul("completion").alias("hangul"), has_han("completion").alias("han"), has_latin("completion").alias("latin"))


_LANG = f"""(CASE WHEN {STRIP("completion")} = '-' THEN true
    WHEN eff = 'zh-TW' THEN regexp_matches(completion, '[一-鿿]') AND NOT regexp_matches(completion, '[ぁ-ゟ゠-ヺー-ヿ가-힣ᄀ-ᇿ]')
    WHEN eff = 'en' THEN regexp_matches(lower(completion), '[a-z]') AND NOT regexp_matches(completion, '[一-鿿ぁ-ゟ゠-ヺー-ヿ가-힣ᄀ-ᇿ]') ELSE true END)"""
_BASE = "base AS (SELECT *, coalesce(nullif(meta.tgt, ''), lang) AS eff FROM targets)"


@query(f"WITH {_BASE} SELECT target_id, {_LANG} AS lang_ok FROM base WHERE completion IS NOT NULL")
def lang_gate(s, d):
    return table(s, d, "targets").filter("completion is not null").select("target_id", gates.lang_ok(gates.effective_lang(), "completion").alias("lang_ok"))


_PRE = r"(?im)<think>|</think>|^#{1,6}" + SP + "|^(here(''s| is| are)|sure|okay|certainly|of course)" + _END + "|以下是|好的[，,]"


@query(f"SELECT target_id, regexp_matches(completion, '{_PRE}') AS preamble FROM targets")
def preamble_gate(s, d):
    return table(s, d, "targets").select("target_id", gates.has_preamble("completion").alias("preamble"))


_TITLE = f"""(NOT contains(completion, chr(10)) AND NOT contains(completion, '"') AND length(completion) <= 90 AND CASE eff WHEN 'en' THEN {WORDS("completion")} <= 10 WHEN 'zh-TW' THEN length(completion) <= 20 ELSE true END)"""


@query(f"WITH {_BASE} SELECT target_id, {_TITLE} AS title_ok FROM base WHERE task = 'title' AND completion IS NOT NULL")
def title_gate(s, d):
    rows = table(s, d, "targets").filter("task = 'title' and completion is not null")
    return rows.select("target_id", gates.title_ok(gates.effective_lang(), "completion").alias("title_ok"))


_SLOT = f"(?im)owner: task|name: what they|due: deadline|負責人[:：]{SP}*(工作內容|無)|期限[:：]{SP}*(無|沒有)|^- (none|n/a|無|沒有)[。.]?$"
_NOTES = f"""(NOT regexp_matches(completion, '{_SLOT}') AND coalesce({FULL("completion")}[1], '') LIKE 'TITLE:%'
    AND {STRIP(f"substr({FULL('completion')}[1], 7)")} <> '' AND length({STRIP(f"substr({FULL('completion')}[1], 7)")}) <= 90 AND {WORDS(f"substr({FULL('completion')}[1], 7)")} <= 10
    AND list_transform(list_filter({FULL("completion")}, lambda x: regexp_matches(x, '^[A-Z]+:')), lambda x: string_split({LINE1("x")}, ' ')[1]) = ['TITLE:', 'SUMMARY:', 'DECISIONS:', 'ACTIONS:', 'OPEN:', 'TOPICS:']
    AND len(list_filter({FULL("completion")}[2:], lambda x: NOT CASE WHEN regexp_matches(x, '^[A-Z]+:') THEN {STRIP("regexp_replace(x, '(?s)^[A-Z]+:', '')")} = '' ELSE x LIKE '- %' OR {STRIP("x")} = '-' END)) = 0)"""


@query(f"SELECT target_id, {_NOTES} AS notes_ok FROM targets WHERE task = 'notes' AND completion IS NOT NULL")
def notes_gate(s, d):
    return table(s, d, "targets").filter("task = 'notes' and completion is not null").select("target_id", gates.notes_ok("completion").alias("notes_ok"))


_JUDGE = "(judge IS NULL OR (NOT coalesce(judge.invert, false) AND (coalesce(judge.faith, 0) = 0 OR judge.faith >= 4)))"


@query(f"SELECT target_id, {_JUDGE} AS judge_ok FROM targets")
def judge_gate(s, d):
    return table(s, d, "targets").select("target_id", gates.judge_ok().alias("judge_ok"))


@query("SELECT target_id, completion IS NOT NULL AND (len(list_filter(string_split(completion, chr(10)), lambda z: " + STRIP("z") + " <> '')) > 12 OR length(completion) > 1200) AS too_long FROM targets")
def too_long(s, d):
    return table(s, d, "targets").select("target_id", (F.col("completion").isNotNull() & gates.too_long("completion")).alias("too_long"))


_NORM = f"regexp_replace(regexp_replace(completion, '(?m)^({SP}*)[*•·–]{SP}+', '\\1- ', 'g'), '(?m)[ \t]+$', '', 'g')"


@query(f"SELECT target_id, {STRIP(_NORM)} AS plain FROM targets")
def plain_bullets(s, d):
    return table(s, d, "targets").select("target_id", gates.plain_bullets("completion").alias("plain"))


_KEEP = f"coalesce({_JUDGE} AND completion IS NOT NULL AND completion <> '' AND length(completion) <= 2600 AND (task <> 'notes' OR {_NOTES}) AND NOT regexp_matches(completion, '{_PRE}') AND {_LANG} AND (task <> 'title' OR {_TITLE}), false)"


@query(f"WITH {_BASE} SELECT target_id, {_KEEP} AS keep FROM base")
def keep_gate(s, d):
    return table(s, d, "targets").select("target_id", gates.keep().alias("keep"))


_EVAL_PRE = r"(?im)<think>|^#{1,6}" + SP + "|^(here(''s| is| are)|sure|okay|certainly)" + _END + "|以下是"
_FMT = f"""coalesce({STRIP("completion")} <> '' AND CASE WHEN task = 'notes' THEN {_NOTES} WHEN regexp_matches(completion, '{_EVAL_PRE}') THEN false
    WHEN task = 'title' THEN NOT contains(completion, chr(10)) AND CASE WHEN eff = 'en' THEN {WORDS("completion")} <= 10 ELSE length(completion) <= 20 END
    WHEN task = 'summarize' THEN len({FULL("completion")}) <= 12 AND length(completion) <= 1600 ELSE true END, false)"""


@query(f"WITH {_BASE} SELECT target_id, {_FMT} AS fmt_ok FROM base")
def format_gate(s, d):
    return table(s, d, "targets").select("target_id", gates.format_ok("task", "completion", gates.effective_lang()).alias("fmt_ok"))


_N = "normed AS (SELECT * REPLACE (" + STRIP(_NORM) + f" AS completion), coalesce(nullif(meta.tgt, ''), lang) AS eff FROM targets)"
_OUT = f"""{_N}, ranked AS (SELECT *, row_number() OVER (PARTITION BY phase = 'reduce', prompt, completion ORDER BY target_id) AS n FROM normed),
    outs AS (SELECT *, CASE WHEN phase = 'reduce' THEN 'reduce' WHEN n > 1 THEN 'dup' WHEN {_KEEP} THEN 'kept' WHEN coalesce(judge.invert, false) THEN 'inverted' WHEN judge.faith BETWEEN 1 AND 3 THEN 'lowfaith' ELSE 'filtered' END AS outcome FROM ranked)"""


@query(f"WITH {_N} SELECT min(target_id) AS target_id FROM normed GROUP BY prompt, completion")
def dedup_keep_first(s, d):
    return curate.keep_first(table(s, d, "targets"), ["target_id"]).select("target_id")


@query(f"WITH {_OUT} SELECT outcome, CASE WHEN outcome = 'kept' THEN CASE WHEN split IN ('train', 'val', 'test') THEN split ELSE 'train' END END AS split, task, count(*) AS n FROM outs GROUP BY ALL")
def curate_outcomes(s, d):
    return curate.outcome_counts(table(s, d, "targets"), ["target_id"])


@query(f"WITH {_OUT} SELECT prompt AS user, completion AS assistant, task, phase, source, eff AS lang, meeting_id, CASE WHEN split IN ('train', 'val', 'test') THEN split ELSE 'train' END AS split FROM outs WHERE outcome = 'kept'")
def training_rows(s, d):
    rows = curate.training_rows(table(s, d, "targets"), ["target_id"])
    return rows.select(F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"), "task", "phase", "source", "lang", "meeting_id", "split")


@query("SELECT row_id, len(messages) - 1 AS n_prompt, messages[-1].role AS role, messages[-1].content AS content FROM sft_rows")
def prompt_completion_split(s, d):
    rows = table(s, d, "sft_rows").select("row_id", curate.prompt_and_completion().alias("x"))
    return rows.select("row_id", F.size("x.prompt").cast("long").alias("n_prompt"), F.col("x.completion")[0]["role"].alias("role"), F.col("x.completion")[0]["content"].alias("content"))


@query("SELECT CASE WHEN lower(trim(split)) IN ('dev', 'validation') THEN 'val' ELSE lower(trim(split)) END AS split, count(*) AS n FROM meetings GROUP BY 1")
def split_names(s, d):
    return table(s, d, "meetings").groupBy(curate.split_alias().alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN split IN ('train', 'val', 'test') THEN split ELSE 'train' END AS split, count(*) AS n FROM meetings GROUP BY 1")
def route_split(s, d):
    return table(s, d, "meetings").groupBy(curate.route().alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 0 AS src_rank, target_id AS id, task, phase FROM targets WHERE judge IS NOT NULL UNION ALL SELECT 1, target_id, task, phase FROM targets WHERE judge IS NULL UNION ALL SELECT 2, row_id, task, phase FROM sft_rows""")
def ordered_union(s, d):
    t = table(s, d, "targets").select(F.col("target_id").alias("id"), "task", "phase", "judge")
    r = table(s, d, "sft_rows").select(F.col("row_id").alias("id"), "task", "phase")
    return curate.in_order(t.filter("judge is not null"), t.filter("judge is null").drop("judge"), r).select("src_rank", "id", "task", "phase")


@query("SELECT target_id FROM targets t WHERE NOT EXISTS (SELECT 1 FROM sft_rows r WHERE r.meeting_id = t.meeting_id AND r.task = t.task AND r.phase = t.phase)")
def resume_anti(s, d):
    return curate.still_to_do(table(s, d, "targets"), table(s, d, "sft_rows"), ["meeting_id", "task", "phase"]).select("target_id")


@query("SELECT target_id, CAST(('0x' || substr(md5(prompt), 1, 7))::INT % 8 AS INT) AS shard FROM targets WHERE prompt IS NOT NULL")
def hash_shard(s, d):
    return table(s, d, "targets").filter("prompt is not null").select("target_id", curate.portable_shard("prompt", 8).alias("shard"))


@query("""WITH n AS (SELECT row_id, source, (SELECT coalesce(sum(length(coalesce(u.text, ''))), 0) FROM (SELECT unnest(utterances) AS u)) AS chars FROM meetings)
    SELECT row_id, source, CAST(chars AS INT) AS chars FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY chars DESC, row_id) <= CASE source WHEN 'dialogsum' THEN 1500 WHEN 'qmsum' THEN 232 WHEN 'vcsum' THEN 1359 WHEN 'meetingbank' THEN 800 ELSE 1000000000 END""")
def cap_per_source_longest(s, d):
    rows = table(s, d, "meetings").select("row_id", "source", curate.text_length().alias("chars"))
    return curate.cap_per_source(rows, planning.SOURCE_CAPS, [F.desc("chars"), "row_id"])


@query("SELECT source, count(*) AS meetings, CAST(sum(len(utterances)) AS BIGINT) AS utterances FROM meetings GROUP BY source")
def source_counts(s, d):
    return curate.source_counts(table(s, d, "meetings"))


_CANDS = "c AS (SELECT prompt, completion, coalesce(judge.faith, 0) AS faith, coalesce(judge.invert, false) AS invert, target_id AS k FROM targets WHERE judge IS NOT NULL AND " + STRIP("coalesce(completion, '')") + " <> '')"


def _candidates(s, d):
    return table(s, d, "targets").filter("judge is not null").select("prompt", "completion", "judge.faith", "judge.invert", F.col("target_id").alias("k"))


_PAIRS = f"""{_CANDS}, g AS (SELECT prompt, count(*) AS n FROM c GROUP BY prompt HAVING count(*) >= 2),
    best AS (SELECT * FROM c WHERE faith >= 4 AND NOT invert QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY faith DESC, k) = 1),
    worst AS (SELECT * FROM c WHERE invert OR faith BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY invert DESC, faith, k) = 1),
    p AS (SELECT g.prompt, best.completion AS chosen, best.faith AS chosen_faith, worst.completion AS rejected, worst.faith AS rejected_faith, worst.invert AS rejected_inverted FROM g JOIN best USING (prompt) JOIN worst USING (prompt) WHERE best.completion <> worst.completion)"""


@query(f"WITH {_PAIRS} SELECT * FROM p")
def pref_pairs(s, d):
    return preferences.pairs(_candidates(s, d), ["prompt"])


@query(f"WITH {_PAIRS} SELECT (SELECT count(*) FROM g) AS prompts, (SELECT CAST(count(*) AS BIGINT) FROM c JOIN g USING (prompt) WHERE invert) AS inverted, (SELECT count(*) FROM p) AS pairs")
def pref_pair_stats(s, d):
    return preferences.pair_stats(_candidates(s, d), ["prompt"])


@query("""SELECT target_id, t.task, coalesce(m.n, 384) AS max_tokens FROM targets t LEFT JOIN (VALUES ('notes', 640), ('summarize', 288), ('actions', 384), ('exec_summary', 224), ('detailed_summary', 512), ('decisions', 320), ('topics', 256), ('open_questions', 320), ('risks_disagreements', 320), ('title', 24)) m(task, n) ON m.task = t.task""")
def task_max_tokens(s, d):
    caps = s.createDataFrame(list(preferences.MAX_TOKENS.items()), "task string, max_tokens int")
    return preferences.max_tokens(table(s, d, "targets").select("target_id", "task"), caps)


@query("SELECT target_id, unnest([0.0, 0.9, 0.9])::DOUBLE AS temperature FROM targets WHERE split = 'train'")
def sample_temperatures(s, d):
    return table(s, d, "targets").filter("split = 'train'").select("target_id", F.explode(preferences.temperatures(3)).alias("temperature"))


_ROWS = f"r AS (SELECT task, length(prompt) AS ntok, judge.faith AS faith, coalesce(length(completion), 0) % 6 AS cover, judge.invert AS invert, {_LANG} AS lang_ok, {_FMT} AS fmt_ok FROM (SELECT *, coalesce(nullif(meta.tgt, ''), lang) AS eff FROM targets) WHERE judge IS NOT NULL)"


def _eval_rows(s, d):
    rows = table(s, d, "targets").filter("judge is not null")
    lang = gates.effective_lang()
    return rows.select("task", F.length("prompt").alias("ntok"), "judge.faith", (F.coalesce(F.length("completion"), F.lit(0)) % 6).alias("cover"), "judge.invert", gates.lang_ok(lang, "completion").alias("lang_ok"), gates.format_ok("task", "completion", lang).alias("fmt_ok"), F.lit(None).cast("string").alias("error"))


_AVG = "count(*) AS n, avg(coalesce(faith, 0)) AS faith, avg(coalesce(cover, 0)) AS cover, avg(CAST(coalesce(faith, 0) <= 2 AS INT)) AS faith_le2, avg(CAST(coalesce(invert, false) AS INT)) AS invert"


@query(f"WITH {_ROWS} SELECT task, {_AVG}, avg(CAST(lang_ok AS INT)) AS lang_ok, avg(CAST(fmt_ok AS INT)) AS fmt_ok FROM r GROUP BY task")
def eval_by_task(s, d):
    return evaluation.by_task(_eval_rows(s, d))


_BUCKET = "CASE WHEN coalesce(ntok, 0) < 4000 THEN 'short' WHEN coalesce(ntok, 0) < 12000 THEN 'medium' ELSE 'long' END"


# Runs of the test table are short; read as so many times longer they fall into all three buckets.
@query(f"SELECT {_BUCKET} AS bucket, {_AVG} FROM (SELECT * REPLACE (ntok * 12 AS ntok) FROM agent_rows) WHERE error IS NULL GROUP BY 1")
def eval_by_length(s, d):
    return evaluation.by_length(table(s, d, "agent_rows").withColumn("ntok", F.col("ntok") * 12))


@query(f"WITH {_ROWS} SELECT task, {_BUCKET} AS bucket, {_AVG} FROM r GROUP BY GROUPING SETS ((task), (bucket))")
def eval_grouping_sets(s, d):
    return evaluation.by_task_and_length(_eval_rows(s, d))


@query(f"SELECT mode, {_AVG}, avg(calls) AS calls, CAST(trunc(avg(prompt_tokens)) AS INT) AS prompt_tokens, avg(CAST(NOT coalesce(regexp_matches(regexp_replace(notes, '(?m)^[A-Z]+:|^\\s*-\\s*$', '', 'g'), '\\S'), false) AS INT)) AS empty FROM agent_rows WHERE error IS NULL GROUP BY mode")
def agent_by_mode(s, d):
    return evaluation.by_mode(table(s, d, "agent_rows"))


@query("SELECT mode, list_sort(list(ntok))[len(list(ntok)) // 2 + 1] AS ntok FROM agent_rows WHERE ntok IS NOT NULL GROUP BY mode")
def upper_median(s, d):
    return evaluation.upper_medians(table(s, d, "agent_rows"), ["mode"], "ntok")


@query("SELECT source, count(*) AS n, count(*) FILTER (judge.invert) AS inversions, count(*) FILTER (judge.faith BETWEEN 1 AND 3) AS low FROM targets WHERE judge IS NOT NULL GROUP BY source")
def judge_stats(s, d):
    return evaluation.judge_stats(table(s, d, "targets"), ["source"])


_ANSWER = """CASE target_id % 5 WHEN 0 THEN 'FAITH: ' || f || ' COVER:' || c || chr(10) || 'INVERT: ' || v WHEN 1 THEN 'Invert: ' || lower(v) || chr(10) || 'FAITH:  ' || f WHEN 2 THEN 'faith: ' || f || chr(10) || 'inVERT:' || v WHEN 3 THEN 'COVER: 1' || c || ' invert: ' || upper(v) ELSE 'no verdict' END"""


@query(f"""WITH a AS (SELECT target_id, {_ANSWER} AS a FROM (SELECT target_id, coalesce(judge.faith, 0) * 3 AS f, target_id % 7 AS c, CASE WHEN judge.invert THEN 'Yes' ELSE 'No' END AS v FROM targets))
    SELECT target_id, coalesce(try_cast(regexp_extract(a, 'FAITH:\\s*(\\d)', 1) AS INT), 0) AS faith, coalesce(try_cast(regexp_extract(a, 'COVER:\\s*(\\d)', 1) AS INT), 0) AS cover, upper(regexp_extract(a, '(?i)INVERT:\\s*(YES|NO)', 1)) = 'YES' AS invert FROM a""")
def judge_parse(s, d):
    f, c, v = (F.coalesce("judge.faith", F.lit(0)) * 3).cast("string"), (F.col("target_id") % 7).cast("string"), F.when(F.col("judge.invert"), "Yes").otherwise("No")
    form, lit = F.col("target_id") % 5, F.lit
    answer = (
        F.when(form == 0, F.concat(lit("FAITH: "), f, lit(" COVER:"), c, lit("\nINVERT: "), v)).when(form == 1, F.concat(lit("Invert: "), F.lower(v), lit("\nFAITH:  "), f))
        .when(form == 2, F.concat(lit("faith: "), f, lit("\ninVERT:"), v)).when(form == 3, F.concat(lit("COVER: 1"), c, lit(" invert: "), F.upper(v))).otherwise("no verdict")
    )
    return table(s, d, "targets").select("target_id", judged(answer).alias("j")).select("target_id", "j.*")


@query("SELECT row_id, task, CASE WHEN x THEN CASE WHEN lang = 'en' THEN 'zh-TW' ELSE 'en' END END AS tgt FROM meetings, (VALUES ('summarize', false), ('summarize', true), ('actions', false), ('title', false), ('exec_summary', false), ('open_questions', false), ('notes', false), ('notes', true)) c(task, x)")
def eval_cases(s, d):
    return table(s, d, "meetings").select("row_id", F.explode(planning.eval_cases()).alias("c")).select("row_id", "c.*")


@query("SELECT row_id, mode FROM meetings, (VALUES ('map'), ('reread'), ('single')) m(mode)")
def meeting_modes(s, d):
    return evaluation.cases(table(s, d, "meetings").select("row_id"), s.createDataFrame([("map",), ("reread",), ("single",)], "mode string"))


@query("SELECT meeting, mode, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM agent_rows GROUP BY ALL")
def call_cost(s, d):
    return evaluation.cost(table(s, d, "agent_rows"))


@query("SELECT target_id FROM targets WHERE split = 'train' AND phase IN ('single', 'map') AND length(prompt) BETWEEN 1000 AND 30000 QUALIFY row_number() OVER (PARTITION BY meeting_id, task ORDER BY target_id) = 1")
def keep_first_long(s, d):
    rows = table(s, d, "targets").filter("split = 'train' and phase in ('single', 'map') and length(prompt) between 1000 and 30000")
    return curate.first_of(rows, ["meeting_id", "task"], ["target_id"]).select("target_id")


@query("""SELECT p.event_id, p.user_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_events(s, d):
    e = table(s, d, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("seen"))
    return notes.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "seen").select("event_id", "user_id", "seen")


_HEADER = "regexp_extract(line, '^([A-Z]+)" + SP + "*[:：]" + SP + "*$', 1)"
# Notes of the test tables have no marks; every "- " item gets one that depends on its row, so that anchors are read, sorted by and rendered.
_MARKED = lambda col, n: f"regexp_replace({col}, '(?m)^(- [^{SP[1:]}.*)$', '\\1 [' || {CLOCK(n)} || ']', 'g')"
_SEC = lambda x: f"coalesce(list_reduce(list_transform(string_split(nullif(regexp_extract({x}, '\\[(\\d+:\\d{{2}}(?::\\d{{2}})?)\\]\\s*$', 1), ''), ':'), lambda q: CAST(q AS INT)), lambda m, q: m * 60 + q), -1)"
_UNMARK = lambda x: f"trim(regexp_replace({x}, '\\[\\d+:\\d{{2}}(?::\\d{{2}})?\\]\\s*$', ''))"
# Strict parser over src (k, t): items with section, place, text and second.
_STRICT = f"""ls AS (SELECT k, {STRIP("unnest(string_split(t, chr(10)))")} AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS seq FROM src),
    hs AS (SELECT *, CASE WHEN {_HEADER} = '' THEN NULL WHEN {_HEADER} IN ('SUMMARY', 'DECISIONS', 'ACTIONS', 'OPEN', 'TOPICS') THEN {_HEADER} ELSE '' END AS h FROM ls),
    ss AS (SELECT *, nullif(last_value(h IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq), '') AS section FROM hs),
    items AS (SELECT k, section, CAST(seq AS INT) AS seq, {STRIP(f"regexp_replace(line, '^[-*•·]{SP}+', '')")} AS item FROM ss WHERE h IS NULL AND section IS NOT NULL AND regexp_matches(line, '^[-*•·]{SP}+')),
    good AS (SELECT k, section, seq, {_UNMARK("item")} AS text, {_SEC("item")} AS at_sec FROM items WHERE item NOT IN ('', '-'))"""
_ITEMS = f"src AS (SELECT target_id AS k, {STRIP(_MARKED('completion', '(target_id * 37 % 4000)'))} AS t FROM targets WHERE task = 'notes'), {_STRICT}"


def _marked(text: str, seconds):
    mark = F.concat(F.lit("$1 ["), clock(seconds), F.lit("]"))
    return F.regexp_replace(text, F.lit(rf"(?dm)^(- [^{SPACE[1:]}.*)$"), mark)


def _note_items(s, d):
    rows = table(s, d, "targets").filter("task = 'notes'").withColumn("completion", _marked("completion", F.col("target_id") * 37 % 4000))
    return notes.note_items(rows, ["target_id"], "completion")


@query(f"WITH {_ITEMS} SELECT k AS target_id, section, seq, text, at_sec FROM good")
def notes_sections(s, d):
    return _note_items(s, d)


_KEYSQL = "trim(regexp_replace(lower(text), '[\\s!-/:-@\\[-`{-~]+', ' ', 'g'))"
_MERGED = lambda same: f"""m AS (SELECT t.meeting_id AS meeting, g.* FROM good g JOIN targets t ON t.target_id = g.k),
    once AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY meeting, section, {same} ORDER BY k, seq) = 1),
    merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY meeting, section ORDER BY at_sec, k, seq) AS INT) AS rank, count(*) OVER (PARTITION BY meeting, section) AS n FROM once)"""  # noqa: E731


def _merged(s, d, exact=False):
    items = _note_items(s, d).join(table(s, d, "targets").select("target_id", F.col("meeting_id").alias("meeting")), "target_id")
    return notes.merge_notes(items.withColumnRenamed("target_id", "chunk"), exact=exact)


@query(f"WITH {_ITEMS}, {_MERGED(_KEYSQL)} SELECT meeting, section, text, at_sec, rank FROM merged")
def merged_notes(s, d):
    return _merged(s, d).select("meeting", "section", "text", "at_sec", "rank")


@query(f"WITH {_ITEMS}, {_MERGED('text')} SELECT meeting, section, text, at_sec, rank FROM merged")
def merged_notes_exact(s, d):
    return _merged(s, d, exact=True).select("meeting", "section", "text", "at_sec", "rank")


_CAPSQL = "CASE section WHEN 'ACTIONS' THEN 6 WHEN 'OPEN' THEN 4 WHEN 'TOPICS' THEN 6 ELSE 5 END"


@query(f"WITH {_ITEMS}, {_MERGED(_KEYSQL)} SELECT meeting, section, rank, text, n > {_CAPSQL} AS over FROM merged WHERE rank <= {_CAPSQL}")
def section_topn(s, d):
    return notes.capped(_merged(s, d)).select("meeting", "section", "rank", "text", "over")


@query(f"WITH {_ITEMS}, {_MERGED(_KEYSQL)} SELECT meeting, section, string_agg('- ' || text, chr(10) ORDER BY rank) AS items FROM merged WHERE n > {_CAPSQL} GROUP BY ALL")
def sections_over_cap(s, d):
    return agent.over_cap(_merged(s, d), notes.CAPS)


@query(f"""WITH {_ITEMS}, {_MERGED(_KEYSQL)}, c AS (SELECT meeting, section, k, min(rank) AS r FROM merged GROUP BY ALL)
    SELECT meeting, section, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) AS chunks FROM c GROUP BY ALL""")
def section_chunks(s, d):
    return notes.chunks_of(_merged(s, d)).select("meeting", "section", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


@query(f"""SELECT target_id, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(completion, chr(10)), lambda x: {STRIP("x")}), lambda x: regexp_matches(x, '^[-*•·]{SP}+')), lambda x: {STRIP(f"regexp_replace(x, '^[-*•·]{SP}+', '')")}), lambda x: x NOT IN ('', '-')), chr(10)) AS items FROM targets""")
def bullet_lists(s, d):
    return table(s, d, "targets").select("target_id", F.array_join(notes.bullets("completion"), "\n").alias("items"))


_AGENT_NOTES = _MARKED("notes", "(ntok % 4000)")


def _agent_notes(s, d):
    return table(s, d, "agent_rows").filter("notes is not null").withColumn("notes", _marked("notes", F.coalesce("ntok", F.lit(0)) % 4000))


@query(f"""WITH src AS (SELECT row_id AS k, {STRIP(f"regexp_replace({_MARKED('notes', '(coalesce(ntok, 0) % 4000)')}, '(?s)<think>.*?</think>', '', 'g')")} AS t FROM agent_rows WHERE notes IS NOT NULL),
    ls AS (SELECT k, {STRIP("unnest(string_split(t, chr(10)))")} AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS seq FROM src),
    hs AS (SELECT *, CASE WHEN {_HEADER} IN ('SUMMARY', 'DECISIONS', 'ACTIONS', 'OPEN', 'TOPICS') THEN {_HEADER} END AS h FROM ls),
    ss AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq), 'SUMMARY') AS section, CASE WHEN line LIKE '- %' AND h IS NULL THEN nullif(nullif({STRIP("substr(line, 3)")}, ''), '-') END AS item FROM hs),
    said AS (SELECT *, bool_or(h IS NOT NULL OR item IS NOT NULL) OVER (PARTITION BY k) AS has FROM ss),
    prose AS (SELECT k, 'SUMMARY' AS section, seq, line AS item FROM said WHERE NOT has AND length(line) > 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) <= 5),
    every AS (SELECT k, section, seq, item FROM said WHERE item IS NOT NULL UNION ALL SELECT * FROM prose)
    SELECT k AS row_id, section, CAST(seq AS INT) AS seq, item AS text, {_SEC("item")} AS at_sec FROM every""")
def lenient_notes(s, d):
    return notes.note_items(_agent_notes(s, d), ["row_id"], "notes", lenient=True)


@query(f"""WITH src AS (SELECT row_id AS k, {STRIP(_MARKED("notes", "(coalesce(ntok, 0) % 4000)"))} AS t FROM agent_rows WHERE notes IS NOT NULL), {_STRICT},
    m AS (SELECT a.meeting, g.* FROM good g JOIN agent_rows a ON a.row_id = g.k),
    once AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY meeting, section, {_KEYSQL} ORDER BY k, seq) = 1),
    lists AS (SELECT meeting, section, string_agg('- ' || text || CASE WHEN at_sec >= 0 THEN ' [' || {CLOCK("at_sec")} || ']' ELSE '' END, chr(10) ORDER BY at_sec, k, seq) AS body FROM once GROUP BY ALL),
    every AS (SELECT meeting, s.section, s.n, coalesce(l.body, '-') AS body FROM (SELECT DISTINCT meeting FROM agent_rows) CROSS JOIN (VALUES ('SUMMARY', 1), ('DECISIONS', 2), ('ACTIONS', 3), ('OPEN', 4), ('TOPICS', 5)) s(section, n) LEFT JOIN lists l USING (meeting, section))
    SELECT meeting, string_agg(section || ':' || chr(10) || body, chr(10) ORDER BY n) AS notes FROM every GROUP BY meeting""")
def rendered_notes(s, d):
    items = notes.note_items(_agent_notes(s, d), ["meeting", "row_id"], "notes").withColumnRenamed("row_id", "chunk")
    return notes.render_notes(notes.merge_notes(items), table(s, d, "agent_rows").select("meeting").distinct(), anchors=True)


@query(f"""WITH {LINES}, starts AS (SELECT row_id, start_sec, max(line_no) AS hit FROM lines GROUP BY ALL), ends AS (SELECT row_id, max(line_no) AS last_no FROM lines GROUP BY ALL),
    anchored AS (SELECT DISTINCT row_id, CASE WHEN line_no % 2 = 0 THEN 'DECISIONS' ELSE 'ACTIONS' END AS section, start_sec + 3 AS at_sec FROM lines),
    hits AS (SELECT a.row_id, a.section, coalesce(s.hit, 0) AS hit FROM anchored a ASOF LEFT JOIN starts s ON a.row_id = s.row_id AND a.at_sec >= s.start_sec),
    wanted AS (SELECT DISTINCT h.row_id, h.section, unnest(range(h.hit, least(h.hit + 2, e.last_no) + 1)) AS line_no FROM hits h JOIN ends e USING (row_id)),
    picked AS (SELECT * FROM wanted QUALIFY row_number() OVER (PARTITION BY row_id, section ORDER BY line_no) <= 40)
    SELECT p.row_id AS meeting, p.section, CAST(p.line_no AS INT) AS line_no, l.line FROM picked p JOIN lines l ON l.row_id = p.row_id AND l.line_no = p.line_no""")
def evidence_lines(s, d):
    lines = transcript.render_lines(table(s, d, "meetings")).select(F.col("row_id").alias("meeting"), "line_no", "start_sec", "line")
    lines = durable(lines, "lines")  # rendered once for its four uses
    anchors = lines.select("meeting", F.when(F.col("line_no") % 2 == 0, "DECISIONS").otherwise("ACTIONS").alias("section"), (F.col("start_sec") + 3).alias("at_sec"))
    return notes.evidence(anchors, lines, section="section")


# The chunks that the agent's queries read: windows of the documents. Their stand-in for a model answers with what it can be checked for.
_WINDOWS = """n AS (SELECT doc_id, text, CASE WHEN length(text) <= 3500 THEN 1 ELSE CAST(ceil((length(text) - 300) / 3200.0) AS INT) END AS n FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, n, chunk, length(substr(text, chunk * 3200 + 1, 3500)) AS size FROM (SELECT *, unnest(range(n)) AS chunk FROM n))"""


def _windows(s, d):
    return chunks.windows(table(s, d, "documents").select(F.col("doc_id").alias("meeting"), "text"))


def _counts_what_it_gets():
    def client(row):
        before, _, chunk = row["prompt"].rpartition("CHUNK ")
        return f"TOPICS:\n- {len(chunk)} characters after {before.count('characters after')} items\n- -"

    return client


@query(f"""WITH {_WINDOWS} SELECT doc_id AS meeting, count(*) AS calls, 'SUMMARY:' || chr(10) || '-' || chr(10) || 'DECISIONS:' || chr(10) || '-' || chr(10) || 'ACTIONS:' || chr(10) || '-' || chr(10) || 'OPEN:' || chr(10) || '-' || chr(10) || 'TOPICS:' || chr(10)
    || string_agg('- ' || size || ' characters after ' || chunk || ' items [c' || chunk || ']', chr(10) ORDER BY chunk) AS notes FROM w GROUP BY doc_id""")
def running_notes(s, d):
    return agent.running_notes(_windows(s, d), "CHUNK {chunk}", _counts_what_it_gets)


def _decides_and_asks_again():
    return lambda row: "c999, c1 and c0, c0" if row["prompt"].startswith("ASK") else f"DECISIONS:\n- {len(row['prompt'])} characters\nTOPICS:\n- x"


@query(f"""WITH {_WINDOWS}, r AS (SELECT doc_id, chunk, size, 0 AS reading FROM w UNION ALL SELECT doc_id, chunk, size, 1 FROM w WHERE n > 1 AND chunk < 2)
    SELECT doc_id AS meeting, CAST(chunk AS INT) AS chunk, reading, unnest(['DECISIONS', 'TOPICS']) AS section, unnest([size || ' characters', 'x']) AS text FROM r""")
def reread_notes(s, d):
    windows = durable(_windows(s, d), "windows")
    items = agent.map_notes(windows, "{chunk}", _decides_and_asks_again)
    return agent.reread_notes(items, windows, "ASK {items}", "{chunk}", _decides_and_asks_again).select("meeting", "chunk", "reading", "section", "text")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    b AS (SELECT vec_id, e, unnest(range(CAST(ceil(len(e) / 32.0) AS INT))) AS i FROM v),
    p AS (SELECT vec_id, i, e[i * 32 + 1 : i * 32 + 32] AS x FROM b),
    q AS (SELECT vec_id, i, x, greatest(list_max(list_transform(x, lambda y: abs(y))), 1e-8::DOUBLE) / 7 AS s FROM p)
    SELECT vec_id, flatten(list(list_transform(x, lambda y: greatest(-8.0::DOUBLE, least(7.0::DOUBLE, round_even(y / s, 0))) * s) ORDER BY i)) AS quantised FROM q GROUP BY vec_id""")
def block_fake_quant(s, d):
    return table(s, d, "embeddings").select("vec_id", vectors.fake_quantised("embedding").alias("quantised"))


_RUNS = """txt AS (SELECT u.text AS t FROM (SELECT unnest(utterances) AS u FROM meetings WHERE lang = 'zh-TW') UNION ALL SELECT completion FROM targets WHERE coalesce(nullif(meta.tgt, ''), lang) = 'zh-TW'),
    runs AS (SELECT unnest(regexp_extract_all(t, '[一-鿿]{2,}')) AS r FROM txt WHERE t IS NOT NULL),
    grams AS (SELECT substr(r, i, n) AS piece FROM (SELECT r, n, unnest(range(1, length(r) - n + 2)) AS i FROM runs, (VALUES (2), (3), (4)) k(n) WHERE length(r) >= n)),
    c AS (SELECT piece, count(*) AS n FROM grams GROUP BY piece HAVING count(*) >= 8)"""


def _pieces(s, d):
    lines = vocabulary.corpus_lines(table(s, d, "meetings"), table(s, d, "targets"))
    known = s.createDataFrame([("專案",), ("會議",)], "piece string")
    return vocabulary.candidates(lines, known)


@query(f"WITH {_RUNS} SELECT * FROM c WHERE piece NOT IN ('專案', '會議')")
def vocab_candidates(s, d):
    return _pieces(s, d)


@query(f"WITH {_RUNS} SELECT * FROM c WHERE piece NOT IN ('專案', '會議') ORDER BY length(piece) DESC, piece LIMIT 100")
def vocab_longest(s, d):
    return vocabulary.longest_first(_pieces(s, d), 100)


@query(f"WITH {_RUNS} SELECT count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM txt WHERE t <> ''")
def corpus_size(s, d):
    return vocabulary.corpus_size(vocabulary.corpus_lines(table(s, d, "meetings"), table(s, d, "targets")))


_PICK = lambda slot, options: f"({options})[1 + CAST(('0x' || substr(md5('0|' || row_id || '|{slot}'), 1, 7)) AS INT) % len({options})]"
_TASKS7 = "['exec_summary', 'detailed_summary', 'action_items', 'decisions', 'topics', 'open_questions', 'risks_disagreements']"
_STYLES3 = "['bullet', 'narrative', 'executive']"
_SLOTS = (("s1", "summarize", "[NULL::VARCHAR]"), ("s2", "summarize", "[NULL, cross_lang, cross_lang]"), ("a", "actions", "[NULL, NULL, cross_lang]"), *((f"i{i}", "insight", "[NULL, NULL, cross_lang]") for i in range(4)), ("n1", "notes", "[NULL::VARCHAR]"), ("n2", "notes", "[NULL, cross_lang]"))
_PLAN = f"""m AS (SELECT row_id, lang, CASE WHEN lang = 'en' THEN 'zh-TW' ELSE 'en' END AS cross_lang, len(list_filter(utterances, lambda u: coalesce(u.speaker, '') <> '')) > 0 AS spoken,
        list_transform(list_sort(list_transform({_TASKS7}, lambda t: {{'h': md5('0|' || row_id || '|' || t), 't': t}})), lambda x: x.t) AS tasks FROM meetings),
    v AS ({" UNION ALL ".join(f"SELECT row_id, lang, '{kind}' AS kind, CASE WHEN spoken THEN {_PICK(slot + '/spk', "['stags', 'stags', 'names']")} ELSE 'none' END AS spk, {_PICK(slot + '/style', _STYLES3) if kind == 'summarize' else 'NULL'} AS style, {f'tasks[{int(slot[1]) + 1}]' if kind == 'insight' else 'NULL'} AS task, {_PICK(slot + '/tgt', tgt)} AS tgt FROM m" for slot, kind, tgt in _SLOTS)}),
    plan AS (SELECT DISTINCT row_id, 'single|{{"kind": "' || kind || '", "spk": "' || spk || '", ' || CASE WHEN kind = 'summarize' THEN '"style": "' || style || '", ' WHEN kind = 'insight' THEN '"task": "' || task || '", ' ELSE '' END
        || '"tgt": ' || coalesce('"' || tgt || '"', 'null') || CASE WHEN kind = 'summarize' THEN ', "zh_instr": ' || CASE WHEN coalesce(tgt, lang) = 'zh-TW' THEN 'true' ELSE 'false' END ELSE '' END || '}}' AS variant_key, spk FROM v)"""


@query(f"WITH {_PLAN} SELECT row_id, variant_key, spk = 'none' AND CAST(('0x' || substr(md5('0|' || variant_key), 1, 7)) AS INT) % 1000 < 300 AS untagged FROM plan")
def variant_plan(s, d):
    plan = planning.plan_variants(table(s, d, "meetings").select("row_id", "lang", "utterances"), "row_id")
    return plan.select("row_id", "variant_key", planning.untagged("variant_key", F.col("variant.spk") != "none").alias("untagged"))


@query("SELECT target_id FROM targets ORDER BY md5('1|' || target_id), target_id LIMIT 1024")
def hash_sample(s, d):
    return curate.shuffled(table(s, d, "targets").select("target_id"), ["target_id"], seed=1, limit=1024)


@query("SELECT target_id, regexp_replace(completion, '(?s)<think>.*?</think>', '', 'g') AS said FROM targets WHERE contains(completion, '<think>')")
def think_removed(s, d):
    return table(s, d, "targets").filter(F.col("completion").contains("<think>")).select("target_id", without_thinking("completion").alias("said"))


@query(f"SELECT target_id, trim({STRIP(f'coalesce({FULL('completion')}[1], {chr(39)}{chr(39)})')}, '\"「」') AS title FROM targets WHERE task = 'title' AND completion IS NOT NULL")
def clean_titles(s, d):
    return table(s, d, "targets").filter("task = 'title' and completion is not null").select("target_id", title_of("completion").alias("title"))


@query(f"SELECT target_id, len({FULL('completion')}) AS lines FROM targets WHERE completion IS NOT NULL")
def line_counts(s, d):
    return table(s, d, "targets").filter("completion is not null").select("target_id", F.size(full_lines("completion")).cast("long").alias("lines"))


@query("SELECT row_id, ntok AS seconds, " + CLOCK("ntok") + " AS mark, ntok AS back, CASE WHEN ntok IS NULL THEN -1 ELSE ntok END AS anchor FROM agent_rows")
def clock_marks(s, d):
    mark = clock(F.col("ntok"))
    anchor = anchor_seconds(F.concat(F.lit("x ["), mark, F.lit("]")))
    return table(s, d, "agent_rows").select("row_id", F.col("ntok").alias("seconds"), mark.alias("mark"), clock_seconds(mark).alias("back"), F.coalesce(anchor, F.lit(-1)).alias("anchor"))


@query("""SELECT target_id, CASE WHEN meta.tgt IS NULL THEN ' Write it in the same language as the transcript.' ELSE ' Write the ENTIRE output in ' || CASE meta.tgt WHEN 'en' THEN 'English' WHEN 'zh-TW' THEN 'Traditional Chinese (繁體中文)' ELSE meta.tgt END || '.' END AS clause FROM targets""")
def language_clauses(s, d):
    clause = planning.language_clause(F.col("meta.tgt"), " Write it in the same language as the transcript.", " Write the ENTIRE output in {target}.")
    return table(s, d, "targets").select("target_id", clause.alias("clause"))


@query(f"""WITH d AS (SELECT target_id, completion, (len({FULL("completion")}) > 12 OR length(completion) > 1200) AS long FROM targets WHERE task = 'summarize' AND {STRIP("coalesce(completion, '')")} <> '')
    SELECT target_id, 'title' AS phase, completion AS text FROM d UNION ALL SELECT target_id, 'shrink', completion FROM d WHERE long""")
def follow_up_prompts(s, d):
    return planning.follow_ups(table(s, d, "targets"))


@query()
def exact_tokens(s, d):
    return table(s, d, "documents").select("doc_id", token_count("text").alias("tokens"))


@query("SELECT row_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT row_id, length(unnest(utterances).text) AS n FROM meetings) GROUP BY row_id")
def utterance_sizes(s, d):
    lines = transcript.utterance_lines(table(s, d, "meetings"))
    return lines.groupBy("row_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))



# ---------------------------------------------------------------- sources of other shapes, made from the meetings

_SAID = "said AS (SELECT row_id, split, pos, nullif(u.speaker, '') AS speaker, coalesce(u.text, '') AS text FROM (SELECT row_id, split, unnest(utterances) AS u, generate_subscripts(utterances, 1) AS pos FROM meetings))"
_ALIAS = "CASE WHEN lower(trim(split)) IN ('dev', 'validation') THEN 'val' ELSE lower(trim(split)) END"
_ID = lambda source: f"'{source}-' || {_ALIAS} || '-' || row_id"


def _shape(df):
    """Normalised meetings with their utterances as one text, which every engine compares alike."""
    said = F.array_join(F.transform("utterances", lambda u: F.concat(F.coalesce(u["speaker"], F.lit("~")), F.lit("|"), u["text"])), "\n")
    return df.select("id", "source", "lang", "split", F.size("utterances").alias("n"), said.alias("said"), F.col("refs.summary").alias("summary"))


def _raw(s, d, text):
    m = table(s, d, "meetings")
    return m.select(F.col("row_id").cast("string").alias("id"), "split", F.coalesce(text, F.lit("")).alias("text"), F.col("refs.summary").alias("summary"), F.col("refs.topics").alias("topics"), "utterances")


_LINES_OF = lambda: F.array_join(F.transform("utterances", lambda u: F.concat(F.coalesce(F.concat(F.nullif(u["speaker"], F.lit("")), F.lit(": ")), F.lit("")), F.coalesce(u["text"], F.lit("")))), "\n")
_TEXTS_OF = lambda sep: F.array_join(F.transform("utterances", lambda u: F.coalesce(u["text"], F.lit(""))), sep)


@query(f"""WITH {_SAID}, d AS (SELECT row_id, split, string_agg(coalesce(speaker || ': ', '') || text, chr(10) ORDER BY pos) AS t FROM said GROUP BY ALL),
    l AS (SELECT row_id, split, list_filter(list_transform(string_split(t, chr(10)), lambda x: {STRIP("x")}), lambda x: x <> '') AS ls FROM d),
    u AS (SELECT row_id, split, list_transform(ls, lambda x: CASE WHEN instr(x, ':') > 0 THEN regexp_replace({STRIP("substr(x, 1, instr(x, ':') - 1)")}, '^#Person(\\d+)#$', 'Person \\1') || '|' || {STRIP("substr(x, instr(x, ':') + 1)")} ELSE '~|' || x END) AS us FROM l)
    SELECT {_ID("dialogsum")} AS id, 'dialogsum' AS source, 'en' AS lang, {_ALIAS} AS split, CAST(len(us) AS INT) AS n, array_to_string(us, chr(10)) AS said, {STRIP("m.refs.summary")} AS summary FROM u JOIN (SELECT row_id AS r, refs FROM meetings) m ON m.r = u.row_id""")
def normalised_dialogsum(s, d):
    raw = _raw(s, d, _LINES_OF()).select("id", F.col("text").alias("dialogue"), "summary", F.lit(None).cast("string").alias("topic"), "split")
    return _shape(normalise.normalise("dialogsum", raw))


@query(f"""WITH {_SAID}, d AS (SELECT row_id, split, {STRIP("string_agg(text, ' ' ORDER BY pos)")} AS t FROM said GROUP BY ALL),
    u AS (SELECT row_id, split, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP("x")}), lambda x: x <> '') AS us FROM d)
    SELECT {_ID("meetingbank")} AS id, 'meetingbank' AS source, 'en' AS lang, {_ALIAS} AS split, CAST(len(us) AS INT) AS n, array_to_string(list_transform(us, lambda x: '~|' || x), chr(10)) AS said, nullif({STRIP("m.refs.summary")}, '') AS summary FROM u JOIN (SELECT row_id AS r, refs FROM meetings) m ON m.r = u.row_id""")
def normalised_meetingbank(s, d):
    raw = _raw(s, d, _TEXTS_OF(" ")).select(F.col("id").alias("uid"), F.col("text").alias("transcript"), "summary", "split")
    return _shape(normalise.normalise("meetingbank", raw))


@query(f"""WITH {_SAID}, d AS (SELECT row_id, split, string_agg(text, chr(10) ORDER BY pos) AS t FROM said GROUP BY ALL),
    u AS (SELECT row_id, split, list_filter(list_transform(string_split(t, chr(10)), lambda x: {STRIP("x")}), lambda x: x <> '') AS us FROM d)
    SELECT {_ID("vcsum")} AS id, 'vcsum' AS source, 'zh-TW' AS lang, {_ALIAS} AS split, CAST(len(us) AS INT) AS n, translate(array_to_string(list_transform(us, lambda x: '~|' || x), chr(10)), '專案會議', '专案会议') AS said, translate(nullif({STRIP("m.refs.summary")}, ''), '專案會議', '专案会议') AS summary FROM u JOIN (SELECT row_id AS r, refs FROM meetings) m ON m.r = u.row_id WHERE len(us) > 0""")
def normalised_vcsum(s, d):
    raw = _raw(s, d, _TEXTS_OF("\n")).select("id", F.col("text").alias("context"), "summary", F.lit(None).cast("array<string>").alias("discussion"), F.col("topics").alias("agenda"), F.lit("1").alias("av_num"), "split")
    return _shape(normalise.normalise("vcsum", raw, convert=normalise.converter(dict(zip("專案會議", "专案会议")))))


_CLEAN = f"{STRIP(f"regexp_replace(regexp_replace(regexp_replace(text, '\\{{[a-z_]+\\}}', ' ', 'g'), '{SP}+([,.!?;:''])', '\\1', 'g'), '{SP}{{2,}}', ' ', 'g')")}"


@query(f"""WITH {_SAID}, c AS (SELECT row_id, split, pos, nullif({STRIP("speaker")}, '') AS speaker, {_CLEAN} AS x FROM said),
    u AS (SELECT row_id, split, count(*) AS n, string_agg(coalesce(speaker, '~') || '|' || x, chr(10) ORDER BY pos) AS said FROM c WHERE regexp_matches(x, '[\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]') GROUP BY ALL)
    SELECT 'qmsum-' || {_ALIAS.replace("split", "m.split")} || '-' || m.row_id AS id, 'qmsum' AS source, 'en' AS lang, {_ALIAS.replace("split", "m.split")} AS split, CAST(coalesce(u.n, 0) AS INT) AS n, coalesce(u.said, '') AS said, m.refs.summary AS summary FROM meetings m LEFT JOIN u ON u.row_id = m.row_id WHERE m.utterances IS NOT NULL""")
def normalised_qmsum(s, d):
    raw = table(s, d, "meetings").filter("utterances is not null").select(
        F.transform("utterances", lambda u: F.struct(u["speaker"].alias("speaker"), F.coalesce(u["text"], F.lit("")).alias("content"))).alias("meeting_transcripts"),
        F.array(F.struct(F.lit("q").alias("query"), F.col("refs.summary").alias("answer"))).alias("general_query_list"), F.lit(None).cast("array<struct<query:string,answer:string>>").alias("specific_query_list"),
        F.lit(None).cast("array<struct<topic:string>>").alias("topic_list"), F.concat(F.col("row_id").cast("string"), F.lit(".json")).alias("file"), "split",
    )
    return _shape(normalise.normalise("qmsum", raw))


# ---------------------------------------------------------------- templates, prompts, choices


@query("SELECT target_id, replace(replace('{lang}: {task} 100% {x} of {lang}', '{lang}', lang), '{task}', task) AS prompt FROM targets")
def filled_templates(s, d):
    return table(s, d, "targets").select("target_id", filled("{lang}: {task} 100% {x} of {lang}", lang=F.col("lang"), task=F.col("task")).alias("prompt"))


@query("""SELECT target_id, array_to_string(list_filter([target_id % 4, 9, target_id % 3, 1], lambda i: i < target_id % 5)[1:2], ',') AS ids FROM targets""")
def reread_choices(s, d):
    i = F.col("target_id")
    answer = F.concat(F.lit("Read c"), (i % 4).cast("string"), F.lit(", c9; c"), (i % 3).cast("string"), F.lit(" and [c1]"))
    return table(s, d, "targets").select("target_id", F.array_join(reread_ids(answer, i % 5).cast("array<string>"), ",").alias("ids"))


@query("SELECT target_id, CAST(('0x' || substr(md5(meeting_id || '|' || task), 1, 7)) AS INT) % 3 AS endpoint FROM targets")
def endpoints(s, d):
    return table(s, d, "targets").select("target_id", preferences.endpoint(["meeting_id", "task"], 3).alias("endpoint"))


@query("SELECT target_id, coalesce(nullif(completion, ''), prompt) AS said FROM targets")
def answer_texts(s, d):
    return table(s, d, "targets").select("target_id", external.answer_text("completion", "prompt").alias("said"))


@query("SELECT target_id FROM targets WHERE split = 'train' AND phase IN ('single', 'map') AND task IN ('notes', 'summarize', 'actions') AND length(prompt) BETWEEN 500 AND 4000")
def selected_targets(s, d):
    return curate.selected(table(s, d, "targets"), ["notes", "summarize", "actions"], shortest=500, longest=4000).select("target_id")


@query("""SELECT target_id, CASE task WHEN 'notes' THEN CASE lang WHEN 'en' THEN 'Notes: ' || prompt WHEN 'zh-TW' THEN '筆記: ' || prompt END WHEN 'title' THEN CASE lang WHEN 'en' THEN 'Title? ' || prompt END END AS asked, CASE task WHEN 'notes' THEN 640 WHEN 'title' THEN 24 ELSE 384 END AS max_tokens FROM targets""")
def prompted_targets(s, d):
    prompts = s.createDataFrame([("notes", "en", None, "Notes: {text}", 640), ("notes", "zh-TW", None, "筆記: {text}", None), ("title", "en", None, "Title? {text}", 24)], planning.PROMPTS)
    rows = table(s, d, "targets").select("target_id", "task", "lang", F.col("prompt").alias("body"))
    return planning.prompted(rows, prompts, text=F.col("body")).select("target_id", F.col("prompt").alias("asked"), "max_tokens")


@query("""WITH n AS (SELECT row_id, source, (SELECT coalesce(sum(length(coalesce(u.text, ''))), 0) FROM (SELECT unnest(utterances) AS u)) AS chars FROM meetings)
    SELECT row_id, source FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN source = 'meetingbank' THEN -chars END, CASE WHEN source <> 'meetingbank' THEN md5('0|' || row_id) END, row_id) <= CASE source WHEN 'dialogsum' THEN 15 WHEN 'qmsum' THEN 23 WHEN 'vcsum' THEN 13 WHEN 'meetingbank' THEN 8 ELSE 1000000000 END""")
def cap_per_source_mixed(s, d):
    rows = table(s, d, "meetings").select("row_id", "source", curate.text_length().alias("chars"))
    caps = {"dialogsum": 15, "qmsum": 23, "vcsum": 13, "meetingbank": 8}
    return curate.cap_per_source(rows, caps, [pick_hash(F.lit(0), "row_id"), "row_id"], {"meetingbank": [F.desc("chars"), "row_id"]}).select("row_id", "source")


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (x + x * 2) / 2) AS mean FROM embeddings")
def mean_vectors(s, d):
    v = F.col("embedding").cast("array<double>")
    return table(s, d, "embeddings").select("vec_id", vectors.mean_vector(F.array(v, F.transform(v, lambda x: x * 2)), len(table(s, d, "embeddings").first()["embedding"])).alias("mean"))


# ---------------------------------------------------------------- files, reports, outside calls


@query("SELECT target_id, completion, meta.style AS style, meta.tgt AS tgt, 2 AS n FROM targets")
def json_lines_roundtrip(s, d):
    """Written, left alone where something is, appended, and read again with the columns that are wanted."""
    path = scratch(s, "lines")
    rows = table(s, d, "targets").select("target_id", "prompt", "completion", "meta")
    jsonl.write_lines(rows, path)
    jsonl.write_lines(rows, path, "ignore")
    jsonl.write_lines(rows, path, "append")
    back = jsonl.json_lines(s, path, "target_id long, completion string, meta struct<style:string,tgt:string>")
    return back.groupBy("target_id", "completion", F.col("meta.style").alias("style"), F.col("meta.tgt").alias("tgt")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT target_id, completion FROM targets WHERE target_id % 7 <> 0")
def tolerant_lines(s, d):
    """Every seventh line is broken off; the tolerant scan skips it and reads the others."""
    path = scratch(s, "broken")
    whole = F.to_json(F.struct("target_id", "completion"))
    table(s, d, "targets").select(F.when(F.col("target_id") % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    return jsonl.json_lines(s, path, "target_id long, completion string", tolerant=True)


@query("SELECT row_id, CASE WHEN split IN ('train', 'val', 'test') THEN split ELSE 'train' END AS split, len(utterances) AS n FROM meetings")
def routed_lines(s, d):
    path = scratch(s, "routed")
    jsonl.write_splits(table(s, d, "meetings").select("row_id", "split", F.size("utterances").cast("long").alias("n")), path)
    return s.read.schema("row_id long, n long, split string").json(path)


@query("SELECT count(*) AS rows, CAST(sum(len(utterances)) AS BIGINT) AS utterances FROM meetings")
def written_counts(s, d):
    return s.createDataFrame([jsonl.write_counted(table(s, d, "meetings").select("row_id", "utterances"), scratch(s, "counted"))], "rows long, utterances long")


@query("""WITH j AS (SELECT source, count(*) AS n, count(*) FILTER (judge.invert) AS inversions, count(*) FILTER (judge.faith BETWEEN 1 AND 3) AS low FROM targets WHERE judge IS NOT NULL GROUP BY source)
    SELECT 'agg' AS part, '{"source":"' || source || '","n":' || n || ',"inversions":' || inversions || ',"low":' || low || '}' AS line FROM j
    UNION ALL SELECT 'results', '{"target_id":' || target_id || ',"faith":' || coalesce(CAST(judge.faith AS VARCHAR), 'null') || '}' FROM targets""")
def report_lines(s, d):
    t = table(s, d, "targets")
    return evaluation.report_lines(evaluation.judge_stats(t, ["source"]), t.select("target_id", F.col("judge.faith").alias("faith")))


def _fails_at_times():
    def client(row):
        if row["target_id"] % 11 == 0:
            raise ValueError("no answer")
        return f"{len(row['prompt'])} characters"

    return client


@query("SELECT target_id, CASE WHEN target_id % 11 <> 0 THEN length(prompt) || ' characters' END AS answer, CASE WHEN target_id % 11 = 0 THEN 'ValueError: no answer' END AS error FROM targets")
def called_rows(s, d):
    return external.called(table(s, d, "targets").select("target_id", "prompt"), _fails_at_times, retries=2, wait=0.0).select("target_id", "answer", "error")


@query(f"WITH {LINES} SELECT row_id, line_no, start_sec, text, '[' || {CLOCK('start_sec')} || '] ' || text AS line FROM lines")
def unlabelled_lines(s, d):
    return transcript.render_lines(table(s, d, "meetings"), "none").select("row_id", "line_no", "start_sec", "text", "line")


_FIRST_LINES = LINES.replace("FROM meetings)", "FROM (SELECT * FROM meetings QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1))")


@query(f"""WITH {_ITEMS}, {_MERGED(_KEYSQL)}, {_FIRST_LINES}, own AS (SELECT m.id AS meeting, l.line_no, l.start_sec, l.line FROM lines l JOIN (SELECT id, row_id FROM meetings) m USING (row_id)),
    over_cap AS (SELECT * FROM merged WHERE n > {_CAPSQL}), lists AS (SELECT meeting, section, string_agg('- ' || text, chr(10) ORDER BY rank) AS items FROM over_cap GROUP BY ALL),
    starts AS (SELECT meeting, start_sec, max(line_no) AS hit FROM own GROUP BY ALL), ends AS (SELECT meeting, max(line_no) AS last_no FROM own GROUP BY ALL),
    hits AS (SELECT a.meeting, a.section, coalesce(x.hit, 0) AS hit FROM (SELECT DISTINCT meeting, section, at_sec FROM over_cap WHERE at_sec >= 0) a ASOF LEFT JOIN starts x ON a.meeting = x.meeting AND a.at_sec >= x.start_sec),
    wanted AS (SELECT DISTINCT h.meeting, h.section, unnest(range(h.hit, least(h.hit + 2, e.last_no) + 1)) AS line_no FROM hits h JOIN ends e USING (meeting)),
    picked AS (SELECT * FROM wanted QUALIFY row_number() OVER (PARTITION BY meeting, section ORDER BY line_no) <= 40),
    ev AS (SELECT p.meeting, p.section, string_agg(o.line, chr(10) ORDER BY p.line_no) AS evidence FROM picked p JOIN own o ON o.meeting = p.meeting AND o.line_no = p.line_no GROUP BY ALL)
    SELECT l.meeting, l.section, l.items, coalesce(ev.evidence, '') AS evidence FROM lists l LEFT JOIN ev ON ev.meeting = l.meeting AND ev.section = l.section""")
def sections_to_compress(s, d):
    first = curate.first_of(table(s, d, "meetings").select("id", "row_id", "lang", "utterances"), ["id"], ["row_id"])
    lines = durable(transcript.render_lines(first, key="id").select(F.col("id").alias("meeting"), "line_no", "start_sec", "line"), "lines")
    return agent.to_compress(durable(_merged(s, d), "merged"), lines, notes.CAPS)


@query("SELECT label AS piece, place, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) GROUP BY label, place")
def piece_means(s, d):
    e = table(s, d, "embeddings")
    means = vectors.piece_means(e.select(F.col("label").alias("piece"), F.col("vec_id").alias("part")), e.select(F.col("vec_id").alias("part"), F.col("embedding").alias("vector")))
    return means.select("piece", F.posexplode("vector").alias("place", "x")).select("piece", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("SELECT row_id, mode, notes, 1 AS files FROM agent_rows")
def json_documents(s, d):
    """One document per file, in one folder per mode."""
    path = scratch(s, "documents")
    table(s, d, "agent_rows").select("row_id", "mode", "notes").write.option("maxRecordsPerFile", 1).partitionBy("mode").json(path)
    back = jsonl.json_documents(s, path, "row_id long, notes string")
    return back.select("row_id", F.replace("split", F.lit("mode="), F.lit("")).alias("mode"), "notes", F.count(F.lit(1)).over(Window.partitionBy("file", "split")).cast("int").alias("files"))


@query(f"WITH {_RUNS}, n AS (SELECT t, {_COST('t')} AS k FROM txt WHERE t <> '') SELECT count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(k) AS BIGINT) AS tokens, sum(length(t)) / sum(k) AS chars_per_token FROM n")
def corpus_tokens(s, d):
    return vocabulary.corpus_size(vocabulary.corpus_lines(table(s, d, "meetings"), table(s, d, "targets")), estimated_tokens)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
