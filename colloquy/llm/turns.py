"""Problem 3: raw utterances into clean speaker turns in order.

Built-in expressions only: fields are extracted by patterns, the marks and
speakers of earlier lines are carried by windows, and consecutive lines of one
speaker become a turn by gaps and islands. One exchange, by row, serves all
windows; what is small in a row (its different speaker labels) is resolved by
higher-order functions before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

U = "(?Ud)"

# The ways in which a recording's time is written, how sounds are noted and what people say while thinking.
_BRACKETED = r"[\[(<〔【（]\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\s*[\])>〕】）]"
_ARROW = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\s*-->\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?"
_BARE = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?![\d:])"
_GAP = r"[\s\u00a0\u3000]"
_ENDING = rf"{_ARROW}|{_BRACKETED}|\d{{1,2}}:\d{{2}}:\d{{2}}[.,]\d{{1,3}}"
_WORDS = (
    "laugh(?:s|ter|ing)?|chuckl(?:es?|ing)|applause|clap(?:s|ping)?|cough(?:s|ing)?|sigh(?:s|ing)?|breath(?:s|ing)?|noise|background noise|music|inaudible|unintelligible|unclear|indistinct|crosstalk|cross ?talk|overlap(?:ping)?|silence|pause|static|beep(?:s|ing)?|ringing|phone rings?|"
    "door (?:slams|opens|closes)|mic(?:rophone)? noise|typing|sneez(?:es?|ing)|sniff(?:s|les)?|gasps?|whisper(?:s|ing)?|clears throat|gap|disfmarker|vocalsound|nonvocalsound|pronounce|blank_audio|"
    "笑聲|笑|掌聲|鼓掌|咳嗽聲?|嘆氣|背景雜音|雜音|噪音|音樂|聽不清楚?|無法辨識|靜默|沉默|停頓|鈴聲|關門聲|敲門聲|交談聲"
)
_SOUND = rf"(?i)(?:\(\(\s*(?:{_WORDS})\s*\)\)|\(\(\s*\)\)|[\[(<{{【〔（*]\s*(?:{_WORDS})\s*[\])>}}】〕）*]|\{{[\p{{L}} _]{{2,24}}\}}|<[\p{{L}} _]{{2,24}}>|\[[\p{{L}} _]{{2,24}}\]|[【〔][\p{{L}} ]{{1,12}}[】〕]|\*[\p{{L}} ]{{2,24}}\*|[♪♫][^♪♫]*[♪♫]?)"
_HESITATION = r"(?:u+h+[ -]huh|mm+[ -]h?mm+|mhm+|u+h+|u+m+|e+r+m+|er+|h+mm+|mm+|hm)"
_LEAD = rf"^{_GAP}*(?:{_SOUND[4:]}{_GAP}*)*"
_FILLER_EN = rf"\b(?:{_HESITATION}|(?:you know|i mean)(?=\s*(?:,|\.\.|…| [-–—])))\b(?!['’])(?<!\bas you know)"
_FILLER_HAN = r"[嗯呃欸唔]|(?<!也)(?:就是說|那個|這個)(?=[，、…]|\.\.)"
_FILLER_CUT = rf"(?i)\s*(?:[-–—] )?(?:(?<![\p{{L}}\d'’-]){_HESITATION}(?![\p{{L}}\d'’])|(?<![\p{{L}}])(?<!(?<![a-z])as )(?:you know|i mean)(?=\s*(?:,|\.\.|…| [-–—])))(?:\.{{2,}}|…+|,| [-–—](?= ))?|[嗯呃欸唔]+哼?[，、。…]*|(?<!也)(?:就是說|那個|這個)(?:[，、]|…+|\.\.+)"
# A number before the colon and one after it are a time; any other label may stand before a number.
_LABEL = r"^\s*((?:Person|Speaker|S)[ _]?#?\d{1,3}(?!\s*[:：]\d)|#Person\d+#|\p{Lu}[\p{L}.'’-]*(?: \p{Lu}[\p{L}.'’-]*){1,3}|\p{IsHan}{2,6})\s*[:：]\s*"


# The signs that a note of sound or a Han filler cannot do without; finding them is much cheaper than the patterns.
_SOUND_SIGNS = ("[", "(", "{", "<", "*", "【", "〔", "（", "♪", "♫")
_HAN_SIGNS = ("嗯", "呃", "欸", "唔", "就是說", "那個", "這個")


def _any(c: Column, signs: tuple[str, ...]) -> Column:
    out = c.contains(signs[0])
    for x in signs[1:]:
        out = out | c.contains(x)
    return out


def has_sound(text: Column) -> Column:
    return _any(text, _SOUND_SIGNS) & text.rlike(_SOUND)


def has_filler(body: Column) -> Column:
    low = F.lower(body)
    return low.rlike(_FILLER_EN) | _any(body, _HAN_SIGNS) & body.rlike(_FILLER_HAN)


def seconds(stamp: Column) -> Column:
    """Of the first time in a mark; null where there is none."""
    parts = F.split(F.regexp_extract(stamp, r"((?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?)", 1), ":")
    part = lambda i: F.regexp_replace(F.try_element_at(parts, F.lit(i)), ",", ".").try_cast("double")
    return F.when(F.size(parts) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(parts) == 2, part(1) * 60 + part(2))


def label_key(label: Column) -> Column:
    """What stays of a speaker's label beside case, spaces, signs and remarks in brackets; "Last, First" is turned round."""
    x = F.regexp_replace(label, U + r"(?<=[\p{L}\d])\s*[(（][^()（）]*[)）]\s*$", "")
    x = F.regexp_replace(x, U + r"^\s*([\p{L}'’-]+)\s*,\s*([\p{L}'’. -]+?)\s*[:：]?\s*$", "$2 $1")
    x = F.lower(F.regexp_replace(x, U + r"[^\p{L}\d.]+", " "))
    x = F.regexp_replace(x, U + r"(?<=\p{L})(?=\d)", " ")
    x = F.regexp_replace(x, U + r"(?<=\p{IsHan})\s+(?=\p{IsHan})", "")
    return F.trim(x)


def _resolve(keys: Column, key: Column) -> Column:
    """A shortened key (first name; initial and last name; first letters of a word with a stop) becomes the first full key of the row that it fits."""
    fits = lambda k: (k != key) & k.rlike(U + r"\S \S") & ~k.contains(".") & F.rlike(k, pattern)
    words = F.regexp_replace(key, U + r"(\p{L}+)\. ?", "$1\\\\p{L}* ")
    pattern = F.concat(F.lit("^"), F.trim(words), F.when(key.contains("."), F.lit("$")).otherwise(F.lit(" ")))
    short = key.contains(".") | ~key.contains(" ") & ~key.rlike(r"\p{IsHan}|\d")
    return F.when(short & (key != ""), F.coalesce(F.try_element_at(F.filter(keys, fits), F.lit(1)), key)).otherwise(key)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, U + r"\s+", " ")), F.lit("")) == ""


def utterances(df: DataFrame) -> DataFrame:
    """One line per utterance of (row_id, utterances): row_id, pos, text, its parts, and the speaker's identity.

    stamp, stamp_s: the recording's time mark at either end and its seconds; label:
    a speaker standing in the text of a line that has none; body: the text without
    mark and label; person: the identity behind the spelling; first_spelling: as that
    person is written first in the row. Null arrays have no lines, null texts are empty.
    """
    spellings = F.array_distinct(F.filter(F.transform("utterances", lambda u: u["speaker"]), lambda s: s.isNotNull() & ~_blank(s)))
    df = df.select("row_id", "utterances", spellings.alias("spellings"))
    df = df.withColumn("keys", F.transform("spellings", label_key))
    df = df.withColumn("persons", F.transform("keys", lambda k: _resolve(F.col("keys"), k)))
    df = df.select("row_id", "spellings", "persons", F.posexplode("utterances").alias("pos", "u"))
    text, speaker = F.coalesce(F.col("u.text"), F.lit("")), F.col("u.speaker")
    lines = df.select("row_id", "pos", "spellings", "persons", text.alias("text"), F.when(~_blank(speaker), speaker).alias("speaker"))
    lines = lines.withColumn("clocked", F.col("text").rlike(r"\d:\d\d"))
    start = F.when(F.col("clocked"), F.nullif(F.regexp_extract("text", f"(?i)({_LEAD})({_ARROW}|{_BRACKETED}|{_BARE})", 2), F.lit("")))
    end = F.when(F.col("clocked"), F.nullif(F.regexp_extract("text", f"(?i)({_ENDING})((?:{_GAP}*{_SOUND[4:]})*{_GAP}*)$", 1), F.lit("")))
    lines = lines.withColumn("start", start).withColumn("end", end)
    cut = F.when(F.col("start").isNotNull(), F.regexp_replace("text", f"(?i)({_LEAD})(?:{_ARROW}|{_BRACKETED}|{_BARE}){_GAP}*", "$1")).otherwise(F.col("text"))
    lines = lines.withColumn("cut", cut)
    cut = F.when(F.col("end").isNotNull(), F.regexp_replace("cut", f"(?i)(?:{_ENDING})((?:{_GAP}*{_SOUND[4:]})*{_GAP}*)$", "$1")).otherwise(F.col("cut"))
    lines = lines.withColumn("cut", cut).withColumn("stamp", F.coalesce("start", "end"))
    label = F.when(F.col("speaker").isNull(), F.nullif(F.regexp_extract("cut", _LABEL, 1), F.lit("")))
    lines = lines.withColumn("label", label)
    named = F.coalesce("speaker", "label")
    lines = lines.withColumn("at", F.array_position("spellings", named).cast("int"))
    person = F.when(F.col("at") > 0, F.try_element_at("persons", "at")).when(F.col("label").isNotNull(), _resolve(F.array_distinct("persons"), label_key(F.col("label"))))
    lines = lines.withColumn("person", person)
    lines = lines.withColumn("first_at", F.array_position("persons", F.col("person")).cast("int"))
    return lines.select(
        "row_id", "pos", "text", "speaker", "stamp", seconds(F.col("stamp")).alias("stamp_s"), "label", "person",
        F.when(F.col("first_at") > 0, F.try_element_at("spellings", "first_at")).otherwise(named).alias("first_spelling"),
        F.when(F.col("label").isNotNull(), F.regexp_replace("cut", _LABEL, "")).otherwise(F.col("cut")).alias("body"),
    )


def find_dirt(df: DataFrame) -> DataFrame:
    """(row_id, pos, dirt_kind): one row for each utterance and kind of dirt in it. Rows without row_id are left out."""
    lines = utterances(df.filter("row_id is not null")).select(
        "row_id", "pos", "stamp_s",
        F.col("stamp").isNotNull().alias("timestamp"),
        has_filler(F.col("body")).alias("filler"),
        has_sound(F.col("text")).alias("sound"),
        (F.col("label").isNotNull() | F.coalesce(F.col("speaker") != F.col("first_spelling"), F.lit(False))).alias("speaker_label"),
    )
    before = Window.partitionBy("row_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("out_of_order", F.coalesce(F.col("stamp_s") < F.max("stamp_s").over(before), F.lit(False)))
    kinds = ("timestamp", "filler", "sound", "speaker_label", "out_of_order")
    found = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in kinds)), lambda k: k.isNotNull())
    return lines.select("row_id", "pos", F.explode(found).alias("dirt_kind")).distinct()


def clean_turns(df: DataFrame) -> DataFrame:
    """(row_id, turn, speaker, at_s, n_lines, text): the turns of each row in order, one label per speaker.

    A line with a time mark stands at its time, one without at that of the line
    before it; equal times keep the stored order. A line without speaker belongs to
    the speaker before it. Lines that hold nothing but noise are dropped before turns
    are joined, so that they part none. Turns count from 0.
    """
    body = F.when(_any(F.col("body"), _SOUND_SIGNS), F.regexp_replace("body", _SOUND, " ")).otherwise(F.col("body"))
    body = F.regexp_replace(body, _FILLER_CUT, " ")
    body = F.regexp_replace(F.regexp_replace(body, U + r"\s+", " "), U + r"\s+([,.!?;:，。！？；：、])", "$1")
    body = F.regexp_replace(F.trim(body), U + r"^[\s,.，、。…–—-]+", "")
    lines = utterances(df.filter("row_id is not null")).select("row_id", "pos", "stamp_s", F.col("first_spelling").alias("name"), body.alias("body"))
    stored = Window.partitionBy("row_id").orderBy("pos")
    lines = lines.withColumn("peak", F.max("stamp_s").over(stored.rowsBetween(Window.unboundedPreceding, -1)))
    steady = F.when(F.coalesce(F.col("stamp_s") >= F.col("peak"), F.lit(True)), F.col("stamp_s"))
    lines = lines.withColumn("at_s", F.coalesce("stamp_s", F.last(steady, ignorenulls=True).over(stored), F.lit(0.0)))
    lines = lines.withColumn("name", F.last("name", ignorenulls=True).over(stored)).filter(F.col("body").rlike(U + r"[\p{L}\d]"))
    timed = Window.partitionBy("row_id").orderBy("at_s", "pos")
    lines = lines.withColumn("new", (~F.col("name").eqNullSafe(F.lag("name").over(timed)) | (F.row_number().over(timed) == 1)).cast("int"))
    lines = lines.withColumn("turn", F.sum("new").over(timed) - 1)
    said = F.array_sort(F.collect_list(F.struct("at_s", "pos", "body")))
    turns = lines.groupBy("row_id", "turn").agg(F.first("name").alias("speaker"), F.min("at_s").alias("at_s"), F.count(F.lit(1)).alias("n_lines"), said.alias("said"))
    return turns.select("row_id", F.col("turn").cast("int").alias("turn"), "speaker", "at_s", "n_lines", F.array_join(F.transform("said", lambda x: x["body"]), " ").alias("text"))
