"""Which prompts to make of which meeting: choices by hash, so that a resumed run chooses the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import pick_hash, pick_number
from colloquy.operators.transcript import has_speakers

# Tasks to draw from, styles, and caps of meetings per source.
INSIGHTS = ("exec_summary", "detailed_summary", "action_items", "decisions", "topics", "open_questions", "risks_disagreements")
STYLES = ("bullet", "narrative", "executive")
SOURCE_CAPS = {"dialogsum": 1500, "qmsum": 232, "vcsum": 1359, "meetingbank": 800}
TARGET_NAMES = {"en": "English", "zh-TW": "Traditional Chinese (繁體中文)"}


#: Columns of the table of prompts: what each task asks in each language, and how many tokens its answer may have. Its rows are settings of the caller, the wording of prompts included.
PROMPTS = "task string, lang string, system string, template string, max_tokens int"


def prompted(rows: DataFrame, prompts: DataFrame, default: int = 384, **slots: Column) -> DataFrame:
    """rows (task, lang, ...) with system, prompt (the template of their task and language with its {slots} filled, null without one) and max_tokens (of the task where the language has none, else default).

    The table of prompts holds one row per task and language, few enough for Spark to
    broadcast them by their size.
    """
    own = prompts.select("task", "lang", "system", "template", F.col("max_tokens").alias("_own"))
    caps = prompts.groupBy("task").agg(F.max("max_tokens").alias("_cap"))
    out = rows.join(own, ["task", "lang"], "left").join(caps, "task", "left")
    text = F.col("template")
    for name, value in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return out.withColumns({"prompt": text, "max_tokens": F.coalesce("_own", "_cap", F.lit(default))}).drop("template", "_own", "_cap")


def pick(slot: str, options: list[Column], key: Column, seed: int = 0) -> Column:
    """One of the options, repeated ones more likely, fixed by seed, key and slot."""
    return F.array(*options)[pick_number(len(options), F.lit(seed), key, F.lit(slot))]


def variant_key(variant: Column) -> Column:
    """single| and the variant as JSON: the keys that its kind has, sorted, with ", " and ": " between; a target that is not set is null."""
    text = lambda k: F.concat(F.lit(f'"{k}": "'), variant[k], F.lit('"'))
    summary = variant["kind"] == "summarize"
    parts = [text("kind"), text("spk"), F.when(summary, text("style")), F.when(variant["kind"] == "insight", text("task"))]
    parts += [F.coalesce(text("tgt"), F.lit('"tgt": null')), F.when(summary, F.concat(F.lit('"zh_instr": '), variant["zh_instr"].cast("string")))]
    return F.concat(F.lit("single|{"), F.concat_ws(", ", *parts), F.lit("}"))


def plan_variants(meetings: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """(key, lang, variant, variant_key), at most nine per meeting: two summaries (the second may cross languages), actions, four of the insight tasks, two notes. Equal variants collapse."""
    k = F.col(key)
    none = F.lit(None).cast("string")
    cross = F.when(F.col("lang") == "en", "zh-TW").otherwise("en")

    def variant(slot: str, kind: str, tgt: list[Column], style: bool = False, task: Column = none) -> Column:
        spk = F.when(has_speakers(), pick(slot + "/spk", [F.lit("stags"), F.lit("stags"), F.lit("names")], k, seed)).otherwise("none")
        to = pick(slot + "/tgt", tgt, k, seed)
        zh = (F.col("lang").eqNullSafe("zh-TW") & to.isNull()) | to.eqNullSafe("zh-TW")
        st = pick(slot + "/style", [F.lit(s) for s in STYLES], k, seed) if style else none
        return F.struct(F.lit(kind).alias("kind"), spk.alias("spk"), st.alias("style"), task.alias("task"), to.alias("tgt"), zh.alias("zh_instr"))

    tasks = F.slice(F.array_sort(F.transform(F.array(*map(F.lit, INSIGHTS)), lambda t: F.struct(pick_hash(F.lit(seed), k, t).alias("h"), t.alias("t")))), 1, 4)
    plan = [variant("s1", "summarize", [none], True), variant("s2", "summarize", [none, cross, cross], True), variant("a", "actions", [none, none, cross])]
    plan += [variant(f"i{i}", "insight", [none, none, cross], task=tasks[i]["t"]) for i in range(4)]
    plan += [variant("n1", "notes", [none]), variant("n2", "notes", [none, cross])]
    rows = meetings.select(key, "lang", F.explode(F.array_distinct(F.array(*plan))).alias("variant"))
    return rows.withColumn("variant_key", variant_key(F.col("variant")))


def untagged(variant_key_col: Column | str, speakers: Column, share: float = 0.3, seed: int = 0) -> Column:
    """Whether the transcript loses its tags: a share of the variants without speakers."""
    return ~speakers & (pick_number(1000, F.lit(seed), variant_key_col) < int(share * 1000))


def language_clause(target: Column | str, auto: str, named: str) -> Column:
    """auto where no target is set, else named with {target} filled by the language's name."""
    t = F.col(target) if isinstance(target, str) else target
    names = F.create_map(*(F.lit(x) for kv in TARGET_NAMES.items() for x in kv))
    return F.when(t.isNull(), F.lit(auto)).otherwise(F.replace(F.lit(named), F.lit("{target}"), F.coalesce(F.try_element_at(names, t), t)))


def eval_cases(lang: Column | str = "lang") -> Column:
    """Array of struct<task, tgt>: the eight cases of an evaluation, two of them across languages."""
    cross = F.when((F.col(lang) if isinstance(lang, str) else lang) == "en", "zh-TW").otherwise("en")
    none = F.lit(None).cast("string")
    cases = (("summarize", none), ("summarize", cross), ("actions", none), ("title", none), ("exec_summary", none), ("open_questions", none), ("notes", none), ("notes", cross))
    return F.array(*(F.struct(F.lit(t).alias("task"), c.alias("tgt")) for t, c in cases))


def follow_ups(targets: DataFrame) -> DataFrame:
    """(target_id, phase, text): second-stage prompts of summaries, "shrink" for those that are too long, "title" for all."""
    from colloquy.functions.text import blank
    from colloquy.operators.gates import too_long

    done = targets.filter((F.col("task") == "summarize") & ~blank("completion"))
    phases = F.filter(F.array(F.when(too_long("completion"), F.lit("shrink")), F.lit("title")), lambda p: p.isNotNull())
    return done.select("target_id", F.explode(phases).alias("phase"), F.col("completion").alias("text"))
