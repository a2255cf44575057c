"""Problem 5: template slots, filler text, error pages and script notices in place of content.

Three kinds of evidence are combined, in the manner of detectors for soft error
pages: what a unit (line or sentence) says, whether the record repeats word for
word under many unrelated hosts (meetings), and whether its title and body share
terms with the record's own prompt (which stands in for the address slug).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Gate, norm
from colloquy.session import durable

KINDS = ("placeholder", "filler_text", "error_page", "script_notice")

_THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
_TAG = re.compile(r"</?(?:html|head|body|title|div|span|p|h\d|br|noscript|center|hr|a|b|i|pre|ul|li|meta|script)\b[^>\n]*>", re.I)

# The ways in which template engines and authors mark an open slot.
_SLOT = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|%\([^()\s]{1,30}\)s|\$\{[^{}\n]{1,80}\}|\[\[[^\[\]\n]{1,80}\]\]|<%[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|(?<![\w%])%[a-z_]{3,30}%(?!\w)|(?<![\w@])@@[a-z_]{2,30}@@"
    r"|<(?:your|insert|enter|add|the|name of|fill)\b[^<>\n]{2,60}>|<[a-z]+(?:[ _-][a-z]+)* here>"
    r"|[\[【(（<](?:insert|your|enter|fill in|add|tbd|todo|to be (?:added|filled|determined|confirmed)|placeholder)\b[^\]】)）>\n]{0,60}[\]】)）>]"
    r"|[\[【(（<](?:請(?:在此)?(?:填|輸)|待補|待填|待定|此處填|填入|在此填|尚未填)[^\]】)）>\n]{0,40}[\]】)）>]"
    r"|\{[a-z]+(?:_[a-z\d]+)+\}|<(?!聽不清|笑聲|掌聲|音樂|咳嗽|嘆氣|停頓|沉默|背景|雜音|多人)[一-鿿]{2,8}>"
    r"|_{4,}|[○〇]{2,}|(?<!\w)x{3,}(?!\w)|\btodo\s*[:：]|^\W*tbd\W*$|\btbd\s*[:：]|\(fill in [^()\n]{1,40}\)|\blabel_\d+\b",
    re.M,
)
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_FILL = re.compile(
    r"^\W*(?:this is (?:a )?(?:placeholder|dummy|sample|filler)|(?:placeholder|dummy|sample|filler) (?:copy|text|paragraph|content)\b|your text goes here|content to follow|text to follow|delete before release"
    r"|the quick brown fox|(?:just )?testing,? (?:testing|one two)|(?:版面)?示意用|(?:此|這)(?:處|裡|段)?(?:為|是)(?:示範|測試|範例|填充)|測試(?:用)?文字|範例文字|示範文字|假文|亂數假文|內容待補|請勿發布)"
)
_ITEM = re.compile(r"^\W*(?:(?:item|point|bullet|line|section|topic|entry|text|heading|paragraph|placeholder|example|項目|要點|重點|內容|條目|文字|標題|段落|範例)\s*[\d一二三四五六七八九十]{1,3})\W*$")
_ERROR = re.compile(
    r"(?:http(?:/[\d.]+)?|error|錯誤)[ :]*[45]\d\d\b|\b[45]\d\d\b[ :,-]*(?:bad gateway|not found|forbidden|unauthori[sz]ed|service (?:temporarily )?unavailable|gateway time-?out|internal server error|too many requests|bad request|request timeout)"
    r"|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|internal server error|too many requests|access denied|you do(?: not|n't) have permission to"
    r"|(?:your |the )?session has (?:expired|timed out)|please (?:sign|log) in again|this (?:page|site) (?:isn't|is not|can't|cannot) (?:be reached|working|available)|try reloading"
    r"|page (?:you requested |was )?(?:not found|could not be found|has been removed)|upstream connect error|the upstream server\b.{0,60}(?:did not respond|timed out|not respond)|connection (?:refused|reset|timed out)"
    r"|traceback \(most recent call last\)|^file \"[^\"]+\", line \d+|^\W*\w*(?:error|exception): \w|deadline exceeded|[\"']error[\"']\s*:|model (?:worker )?\d* ?is overloaded|an? (?:unexpected|unknown|internal) error (?:has )?occurred|something went wrong"
    r"|連線(?:已)?逾時|伺服器(?:沒有|無|未)回應|找不到(?:您|你)?(?:要|所)?的?(?:頁面|網頁)|(?:頁面|網頁)(?:已被移除|不存在)|系統(?:忙線|忙碌|維護)中|請稍後(?:再試|重試)|錯誤代碼|拒絕存取|存取(?:被|遭)拒|(?:您|你)沒有權限|服務(?:暫時)?無法使用|內部伺服器錯誤|登入(?:已)?(?:逾時|過期)|發生(?:未知|內部)錯誤"
)
_SCRIPT_WORD = r"(?:java ?script|\bjs\b|active scripting|scripting|\bscripts?\b|指令碼|腳本)"
_SCRIPT_ACT = r"(?:\benabl\w+|\bturn(?:ed)? on|\bturn\w* it on|\ballow\w*|\bunblock\w*|\bblock(?:s|ed)\b|\bactivat\w+|\bswitch\w* (?:it )?on|\bdisabled?\b|\brequire[sd]?\b|\bneed(?:s|ed)?\b|doesn't work without|does not work without|without|啟用|開啟|允許|停用|關閉|需要|支援)"
_SCRIPT = re.compile(rf"{_SCRIPT_ACT}.{{0,60}}{_SCRIPT_WORD}|{_SCRIPT_WORD}.{{0,60}}{_SCRIPT_ACT}")
#: Who speaks about such things reports them; a notice addresses the reader.
_REPORT = re.compile(
    r"\b(?:asked|said|noted|mentioned|reported|discussed|talked|explained|complained|wondered|agreed|meeting|members?|speakers?|group|team|someone|nobody|project|clerk|analyst|manager|officer|engineer|planner|designer|steward|last (?:week|month|year)|mock-?up|training|workshop|course)\b"
    r"|談到|討論|提到|有人問|表示|報告|同意|與會者|專案|上週|範本裡|說明會|課程"
)


_EDGE = " \t\"'`*•·–-　"


def units(text: str) -> list[str]:
    """Lines, cut into sentences; bullets and quotes stripped."""
    text = text.replace("\r", "\n").replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").replace("。", "。\n")
    return [u for x in text.split("\n") if (u := x.strip(_EDGE).lstrip("#> "))]


def bare(text: str | None) -> str:
    """Normalised, without thinking blocks and tags of a page."""
    text = norm(text)
    if "<think" in text:
        text = _THINK.sub(" ", text)
    return _TAG.sub("\n", text) if "<" in text else text


_LETTER = re.compile(r"[a-z]+")


class Letters:
    """Letter trigrams of all words of the corpus; meaningless strings have improbable ones."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.contexts = counts.reshape(27 * 27, 27).sum(axis=1)

    @staticmethod
    def codes(word: str) -> list[int]:
        a = [0, 0, *(b - 96 for b in word.encode()), 0]
        return [(a[i] * 27 + a[i + 1]) * 27 + a[i + 2] for i in range(len(a) - 2)]

    def score(self, words: list[str]) -> float:
        """Mean log probability of the words' trigrams, their own counts taken out; rare contexts are as improbable as what never follows a common one."""
        own = Counter(i for w in words for i in self.codes(w))
        if not own:
            return 0.0
        at = np.fromiter(own, dtype=np.int64)
        n = np.fromiter(own.values(), dtype=np.int64)
        c, t = np.maximum(self.counts[at] - n, 0), np.maximum(self.contexts[at // 27] - n, 0)
        logp = np.where(t < 5, np.log(1e-3), np.log((c + 0.02) / (t + 0.54)))
        return float((logp * n).sum() / n.sum())


#: Mean log probability of a trigram below which a unit of at least four words is no language.
MEANINGLESS = -5.0


# Frequent words; a unit that holds one is language, whatever its other words are.
_COMMON = re.compile(r"(?<![a-z])(?:the|to|of|and|for|in|on|at|is|was|it|by|with|under|from|this|that|a|an|be|not|project|due|owner|task|title|de|la|el|le|les|die|der|und|des|que|los|las)(?![a-z])")


def meaningless(unit: str, model: Letters | None) -> bool:
    if model is None or unit.count(" ") < 3 or not unit.isascii() or _COMMON.search(unit):
        return False
    words = _LETTER.findall(unit)
    return len(words) >= 4 and sum(map(len, words)) >= 0.7 * len(unit) - 4 and model.score(words) < MEANINGLESS


def repeats(unit: str) -> bool:
    """One short piece said again and again: at least three times, and nothing else."""
    if unit.count(unit[:2]) < 3:
        return False
    x = re.sub(r"[\W_]+", "", unit)
    if len(x) < 6:
        return False
    for n in range(1, min(24, len(x) // 3) + 1):
        if x == (x[:n] * (len(x) // n + 1))[: len(x)] and len(x) // n >= 3:
            return not x.isdigit()
    return False


#: The patterns whose literals a text must hold before they are tried on its units.
GATE = Gate({"slot": _SLOT, "script": _SCRIPT, "error": _ERROR})
_ALL = dict.fromkeys(GATE.names, True)


def unit_kind(unit: str, model: Letters | None = None, items: bool = True, may: dict[str, bool] = _ALL, slug: str | None = None) -> str | None:
    """The kind of residue that one unit is or holds; items: whether a numbered item without content counts; may: of GATE; slug: the prompt, which must not share a term with a unit that only looks meaningless."""
    if may["slot"] and _SLOT.search(unit):
        return "placeholder"
    words = _LETTER.findall(unit)
    if len(words) >= 3 and sum(w in _LATIN for w in words) >= 0.75 * len(words) and len(set(words) & _LATIN) >= 3:
        return "filler_text"
    if _FILL.search(unit) or items and len(unit) < 40 and _ITEM.search(unit) or repeats(unit):
        return "filler_text"
    if may["script"] and _SCRIPT.search(unit) and not _REPORT.search(unit):
        return "script_notice"
    if may["error"] and (m := _ERROR.search(unit)) and (m.start() <= 14 or len(m.group()) >= 0.5 * len(unit)) and not _REPORT.search(unit[m.end() :]):
        return "error_page"
    if meaningless(unit, model) and (slug is None or mismatch(slug, unit)):
        return "filler_text"
    return None


def residue_kind(completion: str | None, model: Letters | None = None, slug: str | None = None) -> str | None:
    """The kind of residue that the text is or holds; the strongest evidence first. slug: the record's prompt.

    Numbered items without content ("Item 1") count from three on, or where two make up the text.
    """
    text = bare(completion)
    if not text.strip():
        return None
    parts, may = units(text), GATE.may(text)
    found = {kind for u in parts if (kind := unit_kind(u, model, may=may, slug=slug))}
    if found == {"filler_text"}:
        items = sum(len(u) < 40 and bool(_ITEM.search(u)) for u in parts)
        others = sum(unit_kind(u, model, False, may, slug) == "filler_text" for u in parts)
        if not others and items < min(3, max(2, 0.8 * len(parts))):
            return None
    return next((kind for kind in ("placeholder", "script_notice", "error_page", "filler_text") if kind in found), None)


def letter_counts(df: DataFrame, column: str) -> np.ndarray:
    """Trigram counts of letters over all rows. What comes to the driver is one table of 27^3 numbers per partition, summed first."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(27**3, dtype=np.int64)
        known: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                if text:
                    known.update(_LETTER.findall(text.lower()))
            if len(known) > 200_000:
                _add(total, known)
                known = Counter()
        _add(total, known)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    counts = df.select(F.col(column).alias("t")).mapInPandas(kernel, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27**3, dtype=np.int64)
    for r in counts:
        out[r["at"]] = r["n"]
    return out


def _add(total: np.ndarray, words: Counter) -> None:
    for w, n in words.items():
        for i in Letters.codes(w):
            total[i] += n


# ---------------------------------------------------------------- operator

#: Unrelated hosts (meetings) under which a response must stand to count as duplicated, and terms up to which it says little.
HOSTS, LITTLE = 5, 24
#: Points of combined evidence that residue must exceed: see evidence().
ENOUGH = 5
_MASK = re.compile(r"\d+")
_TERM = re.compile(r"[a-z]{4,}|[一-鿿]{2,}")

# Words of the detectors that hardly occur in talk about other things.
_WEAK = (
    ("script_notice", re.compile(r"java ?script|\bscripts?\b|\bcookies\b|指令碼|腳本")),
    ("error_page", re.compile(r"\berrors?\b|\bhttp\b|\bgateway\b|\bdenied\b|\bpermission\b|\bexpired\b|\btimed? ?out\b|\bupstream\b|\bunavailable\b|\breload\w*|\bexception\b|\boverloaded\b|\bnot found\b|逾時|伺服器|錯誤|權限|存取|登入")),
    ("filler_text", re.compile(r"\bplaceholder\b|\bdummy\b|\blorem\b|假文|內容待補")),
)


def weak_kind(text: str) -> str | None:
    """The kind that a text hints at, unless it reports about such things."""
    return None if _REPORT.search(text) else next((kind for kind, p in _WEAK if p.search(text)), None)


def terms(text: str) -> set[str]:
    """Content terms of a text: words of four letters or more, pairs of Han characters."""
    out: set[str] = set()
    for w in _TERM.findall(text):
        if w.isascii():
            out.add(w)
        else:
            out.update(w[i : i + 2] for i in range(len(w) - 1))
    return out


def mismatch(slug: str | None, completion: str) -> bool:
    """True if title and body of a page share no content term with what its address stands for, the prompt."""
    body = terms(completion)
    return not body & terms(norm(slug)) if body else False


def says_again(text: str) -> bool:
    """True if a page's body has no term beside those of its title, its first line."""
    title, _, body = text.strip().partition("\n")
    return bool(said := terms(body)) and said <= terms(title)


def evidence(hosts: Column, off: Column, few: Column, hint: Column, again: Column) -> Column:
    """Points of a response for residue.

    2 if it stands, digits aside, under at least HOSTS hosts, 2 if most of its rows
    mismatch their slugs, 1 each if it says little, if a detector's word hints at a
    kind, if its body only says its title again. Duplicated and mismatched text that
    neither hint nor repetition supports, such as a refusal, does not get over ENOUGH.
    """
    one = lambda c: c.cast("int")
    return one(hosts >= HOSTS) * 2 + one(off > 0.5) * 2 + one(few) + one(hint.isNotNull()) + one(again)


def find_residue(df: DataFrame) -> DataFrame:
    """(target_id, residue_kind) of records with target_id, meeting_id, prompt, completion.

    One pass settles what the placeholder detectors see in a unit, and writes of all
    other responses a digest without digits, host and the features of evidence(). They
    are summed per digest, first by (digest, host), so that no host and no digest is one
    task's work; a response is residue by combined evidence if it is duplicated and
    mismatched and has more than ENOUGH points, whatever its length, hinted at or not.
    Null and empty completions are no case; rows without target_id are left out;
    repeated rows give one row.
    """
    model = Letters(letter_counts(df, "completion"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, host, p, c in zip(b["i"], b["host"], b["p"], b["c"]):
                kind = residue_kind(c, model, p)
                if kind:
                    rows.append((i, kind, None, None, False, False, None, False))
                    continue
                text = bare(c).strip()
                if said := terms(text):
                    mask = blake2b(_MASK.sub("0", text).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((i, None, mask, host, not said & terms(norm(p)), len(said) <= LITTLE, weak_kind(text), says_again(text)))
            if rows:
                yield pd.DataFrame(rows, columns=["i", "kind", "mask", "host", "off", "few", "hint", "again"])

    picked = df.select(F.col("target_id").cast("long").alias("i"), F.col("meeting_id").alias("host"), F.col("prompt").alias("p"), F.col("completion").alias("c")).filter("i is not null")
    seen = durable(picked.mapInPandas(kernel, "i long, kind string, mask binary, host string, off boolean, few boolean, hint string, again boolean"), "residue")
    strong = seen.filter("kind is not null").select("i", "kind")
    number = lambda c: F.col(c).cast("int")
    per_host = seen.filter("mask is not null").groupBy("mask", "host").agg(F.count(F.lit(1)).alias("n"), F.sum(number("off")).alias("off"), F.max(number("few")).alias("few"), F.max("hint").alias("hint"), F.max(number("again")).alias("again"))
    pages = per_host.groupBy("mask").agg(F.count("host").alias("hosts"), (F.sum("off") / F.sum("n")).alias("off"), F.max("few").alias("few"), F.max("hint").alias("hint"), F.max("again").alias("again"))
    points = evidence(*(F.col(c) for c in ("hosts", "off", "few", "hint", "again")))
    flagged = pages.filter((F.col("hosts") >= HOSTS) & (F.col("off") > 0.5) & (points > ENOUGH)).select("mask", F.coalesce("hint", F.lit("filler_text")).alias("kind"))
    combined = seen.filter("mask is not null").select("i", "mask").join(flagged, "mask").select("i", "kind")
    return strong.unionByName(combined).select(F.col("i").alias("target_id"), F.col("kind").alias("residue_kind")).distinct()


def without_residue(df: DataFrame) -> DataFrame:
    """The records that hold none, all columns kept."""
    return df.join(find_residue(df).select("target_id"), "target_id", "left_anti")
