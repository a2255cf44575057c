"""Column expressions on text that agree with Unicode-aware string handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of patterns: Unicode classes, only \n ends a line.
U = "(?Ud)"
#: All white space, the separators U+001C to U+001F included, written out so that SQL engines can share it.
SPACE = r"[\s\x0b\x1c-\x1f\u0085   -     　]"

# Ranges of scripts; the middle dot U+30FB is no kana.
KANA = "[ぁ-ゟ゠-ヺー-ヿ]"
HANGUL = "[가-힣ᄀ-ᇿ]"
HAN = "[一-鿿]"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def one_line(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def blank(c: Column | str) -> Column:
    return strip(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))) == ""


def word_count(c: Column | str) -> Column:
    line = one_line(c)
    return F.when(line == "", F.lit(0)).otherwise(F.size(F.split(line, " ")))


def full_lines(c: Column | str) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def has_kana(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(KANA)


def has_hangul(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(HANGUL)


def has_han(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(HAN)


def has_latin(c: Column | str) -> Column:
    return F.lower(c).rlike("[a-z]")


def estimated_tokens(c: Column | str) -> Column:
    """An estimate: 1.67 Han or kana characters to a token, 4 others. For exact counts pass a tokenizer's column instead."""
    n = F.length(c)
    rest = F.length(F.regexp_replace(c, r"[ぁ-ヿ一-鿿]", ""))
    return F.ceil((n - rest) / 1.67 + rest / 4.0).cast("int")


def digit_after(c: Column | str, key: str) -> Column:
    """One digit after "KEY:", 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, rf"{key}:[\s]*(\d)", 1).try_cast("int"), F.lit(0))


def yes_after(c: Column | str, key: str) -> Column:
    return F.lower(F.regexp_extract(c, rf"(?i){key}:[\s]*(YES|NO)", 1)) == "yes"


def judged(answer: Column | str) -> Column:
    """struct<faith, cover, invert> of a judge's answer; what is missing counts 0 and false."""
    return F.struct(digit_after(answer, "FAITH").alias("faith"), digit_after(answer, "COVER").alias("cover"), yes_after(answer, "INVERT").alias("invert"))


def without_thinking(c: Column | str) -> Column:
    return F.regexp_replace(c, "(?s)<think>.*?</think>", "")


def pick_hash(*parts: Column | str) -> Column:
    """MD5 of the parts joined by |: the same on every engine, unlike the engines' own hashes."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts)))


def pick_number(of: int | Column, *parts: Column | str) -> Column:
    """A number from 0 to of - 1 fixed by the parts: the first 7 hex digits of their hash, modulo."""
    return (F.conv(F.substring(pick_hash(*parts), 1, 7), 16, 10).cast("long") % of).cast("int")


def title_of(c: Column | str) -> Column:
    """First line that is not blank, without quotes around it."""
    return F.btrim(strip(F.coalesce(F.try_element_at(full_lines(c), F.lit(1)), F.lit(""))), F.lit('"「」'))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} slots, filled by columns; other braces and percent signs stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def reread_ids(answer: Column | str, chunks: Column, most: int = 2) -> Column:
    """Chunk numbers named as c<number>, those that exist, the first few."""
    ids = F.transform(F.regexp_extract_all(answer, F.lit(r"c(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.slice(F.filter(ids, lambda i: i.isNotNull() & (i < chunks)), 1, most)
