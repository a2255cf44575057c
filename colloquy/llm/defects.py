"""Problem 2: prompt and response pairs whose response is defective.

One type per record, tried in this order (residue of problem 5 is no case):
empty, refusal, copied_prompt, wrong_language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import residue
from colloquy.llm.common import HAN, WORD, letters, norm
from colloquy.session import durable

TYPES = ("empty", "truncated", "refusal", "copied_prompt", "wrong_language")

# ---------------------------------------------------------------- empty

_INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]+")


def says_nothing(text: str | None) -> bool:
    """True if nothing is left beside white space, invisible characters, markup and thinking. A lone dash says that there is nothing to report."""
    rest = residue.bare(text)
    rest = rest.replace("&nbsp;", " ")
    if _INVISIBLE.sub("", rest) in ("-", "–", "—", "−"):
        return False
    return not any(ch.isalnum() or unicodedata.category(ch)[0] == "S" and ch not in "`^~+=|$<>" for ch in rest)


# ---------------------------------------------------------------- refusal

# How a model declines or asks for other input, in normalised form.
_DECLINES = (
    "i can't help", "i cannot help", "i can not help", "i can't assist", "i cannot assist", "i'm unable to", "i am unable to", "i'm not able to", "i am not able to", "i won't be able", "i will not be able",
    "i must decline", "i have to decline", "i need to decline", "i must refuse", "i decline to", "i can't provide", "i cannot provide", "i can't produce", "i cannot produce", "i can't summarize", "i cannot summarize", "i can't process", "i cannot process",
    "i can't write", "i cannot write", "i can't comply", "i cannot comply", "i can't fulfil", "i cannot fulfil", "i can't do that", "i cannot do that", "i can't access", "i cannot access", "i have no access", "i don't have access", "i do not have access", "i have no way",
    "there is no way for me", "it would not be appropriate", "it wouldn't be appropriate", "not something i can", "not something i am able", "outside what i may", "outside what i can", "beyond what i can", "beyond what i may", "i may not answer", "i'm not comfortable", "i am not comfortable",
    "against my guidelines", "content guidelines", "content policy", "as a language assistant", "as an ai", "as a language model", "as an assistant, i", "please provide a different", "please provide the", "please share the transcript", "please paste", "please upload", "could you provide the", "could you share the", "you have not provided", "you haven't provided", "no transcript was", "i don't see a transcript", "i do not see a transcript", "there is nothing for me to", "may contain sensitive", "sensitive matters",
    "我不能", "我無法", "我没有", "我沒有辦法", "我沒辦法", "我必須婉拒", "我必須拒絕", "婉拒這項", "婉拒此", "無法協助", "不能協助", "無法提供", "無法產生", "無法處理這", "無法完成這項", "無從摘要", "超出我可以", "超出我能", "超出我的", "您沒有附上", "你沒有附上", "沒有附上內容", "沒有看到您", "請提供其他", "請提供會議", "請提供逐字稿", "請附上", "身為語言", "作為語言", "身為ai", "作為ai", "身為人工智慧", "作為人工智慧", "不方便回答", "不便評論", "不便回應", "可能涉及敏感", "不適合由我", "我不便",
)
#: Units that only accompany a refusal.
_POLITE = re.compile(r"^\W*(?:summary\W*)?(?:i'm sorry|i am sorry|sorry|i apologi[sz]e|apologies|thanks? (?:you )?for asking|thank you|unfortunately|regrettably|however|sure|let me know|please (?:let|tell|provide|share|send|try)|if (?:you|there)|is there|(?:很|非常)?抱歉|對不起|不好意思|如有|若有|請提供|請告訴|謝謝|感謝|摘要)")


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


_REFUSAL = _automaton(_DECLINES)


def is_refusal(text: str) -> bool:
    """text: normalised. A refusal's units decline or accompany that; real content beside it makes it none."""
    text = text.replace("’", "'")
    if next(_REFUSAL.iter(text), None) is None:
        return False
    said = declined = 0
    for u in residue.units(text):
        n = len(letters(u))
        if next(_REFUSAL.iter(u), None) is not None:
            declined += n
        elif not _POLITE.search(u):
            said += n
    return declined >= 0.5 * (said + declined)


# ---------------------------------------------------------------- copied prompt


class SuffixAutomaton:
    """Of a sequence of tokens. Built once per prompt in linear time; a response is then traversed token by token."""

    __slots__ = ("end", "length", "link", "next")

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, token in enumerate(tokens):
            cur = self._state({}, 0, self.length[last] + 1, at)
            p = last
            while p != -1 and token not in self.next[p]:
                self.next[p][token] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][token]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.end[q])
                    while p != -1 and self.next[p].get(token) == q:
                        self.next[p][token] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, nxt: dict[str, int], link: int, length: int, end: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.length) - 1

    def runs(self, tokens: list[str], least: int) -> list[tuple[int, int, int]]:
        """(start, end, place in the automaton's sequence) of the longest shared runs of at least so many tokens, each token in one run."""
        out: list[tuple[int, int, int]] = []
        state = n = 0
        for i, token in enumerate([*tokens, None]):
            before = (n, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if token is not None and token in self.next[state]:
                state, n = self.next[state][token], n + 1
            else:
                state = n = 0
            if n <= before[0] and before[0] >= least:  # the run that ended at i - 1 could not be extended
                start = max(i - before[0], out[-1][1] if out else 0)
                if i > start:
                    out.append((start, i, self.end[before[1]] - (i - start) + 1))
        return out


#: Shares from which a response is a copy: of its own words, and of the prompt's body (unless it is the instructions that are copied).
COPIED_OWN, COPIED_BODY, RUN = 0.75, 0.5, 4
#: Most tokens of an opening before the copy; it is less than half of the response.
OPENING = 12
_HEAD_END = re.compile(r"(?:^|[\n\r.。*_ ])(?:meeting\s+transcript|transcript|summary|items|逐字稿|摘要)[ \t*_]*(?:[:：]|[ \t][-–](?=\s)|(?=[\n\r]))")


def may_copy(prompt: str, tokens: list[str]) -> bool:
    """Exact necessary condition for COPIED_OWN, so that the automaton is built for likely copies only.

    A token in a shared run of RUN tokens stands in a window of so many whose letters,
    joined, stand among the prompt's. Tokens in no such window beyond those that an
    opening and 1 - COPIED_OWN of the rest may take rule a copy out.
    """
    p, n = letters(prompt), len(tokens)
    if not p or not n:
        return False
    size = min(RUN, n)
    spare = n - COPIED_OWN * (n - min(OPENING, n / 2))
    missing, covered = 0, 0  # tokens before `covered` are in a window that is there
    for i in range(n):
        if i + size <= n and "".join(tokens[i : i + size]) in p:
            covered = i + size
        elif i >= covered:
            missing += 1
            if missing > spare:
                return False
    return True


def is_copied(prompt: str, completion: str, gate: bool = True) -> bool:
    """prompt, completion: normalised. Without the gate the automaton is always built; the answer is the same."""
    tokens = WORD.findall(completion)
    if gate and not may_copy(prompt, tokens):
        return False
    head = _HEAD_END.search(prompt)
    cut = head.end() if head else len(prompt)
    front, body = WORD.findall(prompt[:cut]), WORD.findall(prompt[cut:])
    least = min(RUN, max(1, len(tokens)))
    runs = SuffixAutomaton(front + body).runs(tokens, least)
    if not runs:
        return False
    opening = runs[0][0] if runs[0][0] <= OPENING and runs[0][0] < 0.5 * len(tokens) else 0
    copied = sum(e - s for s, e, _ in runs)
    if copied < COPIED_OWN * (len(tokens) - opening):
        return False
    in_front = sum(e - s for s, e, at in runs if at < len(front))
    return in_front >= 0.8 * copied or copied - in_front >= COPIED_BODY * len(body)


# ---------------------------------------------------------------- language

# Function words that vote for a language.
_STOP = {
    "en": "the and of to in is was for that with on by will be at from it as not has had were are this which would could should can must after before under until although while about once",
    "de": "der die das und nicht ist wird den dem des ein eine einen zu mit auf für von im bis sich noch erst wurde werden über es sind haben hat beschloss nächsten",
    "fr": "le la les des et est une un du au aux que qui dans pour pas sur avec ce cette par ont été il reste sont nous plus avant fin deux",
    "es": "el la los las de y en que un una para por con del al se más hasta antes sobre fue han está este esta próxima faltan",
    "it": "il lo gli di che è per con una non sono della nel alla prima stato ha questo anche",
    "pt": "o os as de que não em um uma para com do da no na mais foi até por sobre são reunião",
    "nl": "de het een van en niet is dat op te met voor zijn werd wordt nog tot over aan bij",
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in _STOP.items():
    for _w in _words.split():
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)
_KANA = re.compile(r"[ぁ-ゟ゠-ヺー-ヿ]")
_HANGUL = re.compile(r"[가-힣ᄀ-ᇿ]")
_OTHER = re.compile(r"[Ͱ-῿฀-๿]")
_LATIN = re.compile(r"[a-zß-ÿ]+")
_FIELD = re.compile(r"(?:^|(?<=[^\w]))(?:title|summary|decisions|actions|open|topics|owner|task|due)\W*[:：-]")
# Frequent characters that only the simplified script writes so.
_SIMPLIFIED = re.compile("[们这说对时实应该议记录门问题员为东车长开关见现动务报业电场广发产经过还进点达给让与个]")


#: Share of the words that must vote for another language than English.
VOTES = 0.1


def language(text: str) -> str | None:
    """Of normalised text; None where too little is said to tell."""
    text = _FIELD.sub(" ", text)
    han, kana, hangul = len(HAN.findall(text)), len(_KANA.findall(text)), len(_HANGUL.findall(text))
    words = _LATIN.findall(text)
    if hangul > 0.2 * (han + kana + hangul + len(words)):
        return "ko"
    if kana and kana > 0.1 * (han + kana):
        return "ja"
    if len(_OTHER.findall(text)) > 0.5 * sum(map(len, words)) + han:
        return "other"
    if han > 1.5 * len(words):
        return "zh-CN" if len(_SIMPLIFIED.findall(text)) > 0.15 * han else "zh-TW"
    if han * 2 > len(words):
        return None
    votes = Counter(lang for w in words for lang in _VOTES.get(w, ()))
    if not votes:
        return "latin" if len(words) >= 3 else None
    best, n = votes.most_common(1)[0]
    return best if n > max(1, votes["en"], VOTES * len(words)) else "en"


def wrong_language(text: str, due: str | None) -> bool:
    """en is not due in Han, zh-TW not in Latin; without votes, Latin script passes for en."""
    said = language(text)
    if said is None or due not in ("en", "zh-TW"):
        return False
    return said not in (("en", "latin") if due == "en" else ("zh-TW",))


# ---------------------------------------------------------------- truncated

_OPEN, _CLOSE = "([{（「『【〔《", ")]}）」』】〕》"
_PAIR = dict(zip(_CLOSE, _OPEN))
_STOPS = re.compile(r"[.!?。！？…][\"'”’」』)）*_`~ ]*$")
_TAIL = re.compile(r"[,，、;；:：(（\[{「『/&+]\s*$|(?<=\w)[-–—]$")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_BULLET = re.compile(r"^\s*(?:[-–•*·#>]+|\d{1,2}[.)])\s*")
_SECTIONS = re.compile(r"(?<![^\W_])(title|summary|decisions|actions|open|topics)[*_]*[ \t]*(?:[:：]|[-–](?=\s)|(?=[\r\n]|$))")
_KEYED = re.compile(r"(?<![^\W_])(owner|task|due|期限)[\"'”* \t]*(?:[:：]|[-–](?=\s))")


_DASHES = ("-", "•", "*", "·", "–")


def unclosed(text: str) -> bool:
    """A stack of delimiters: something was opened and not closed by the end."""
    stack: list[str] = []
    for ch in text:
        if ch in _OPEN:
            stack.append(ch)
        elif ch in _PAIR and stack and stack[-1] == _PAIR[ch]:
            stack.pop()
    return bool(stack) or text.count("```") % 2 == 1


def lines_of(text: str) -> list[str]:
    return [u for x in re.split(r"[\r\n]+", text) if (u := _BULLET.sub("", x).strip(" \t*_\xa0　"))]


def tokens_of(unit: str) -> list[str]:
    """Words with digits masked; of Han text overlapping pairs of characters."""
    unit = _DIGITS.sub("9", unit)
    if len(HAN.findall(unit)) > 0.4 * len(unit):
        x = re.sub(r"[^\w]+", "", unit)
        return [x[i : i + 2] for i in range(len(x) - 1)] or [x]
    return re.findall(r"[^\W_]+", unit)


def _h(kind: str, *parts: str) -> int:
    v = xxhash.xxh64_intdigest("\x1f".join((kind, *parts)))
    return v - (1 << 64) if v >> 63 else v


def start_of(tokens: list[str]) -> int:
    return _h("s", *(tokens[:2] if len(tokens) > 4 else tokens[:1]))


def end_keys(tokens: list[str]) -> list[int]:
    """Keys of a unit's end: last word, last two words, start with last word, start."""
    a, b = tokens[-1], tokens[-2] if len(tokens) > 1 else ""
    start = start_of(tokens)
    return [_h("1", a), _h("2", b, a), _h("3", str(start), a), start]


def end_counts(texts: Iterator[str | None]) -> Iterator[list[tuple[int, int, int, int | None]]]:
    """Of all complete units: (key, times at an end, times at all, the start that a start-and-last-word key belongs to), in parts whenever much has come together."""
    words: Counter = Counter()
    ends: Counter = Counter()

    def part() -> list[tuple[int, int, int, int | None]]:
        found: dict[int, list] = {_h("1", w): [0, n, None] for w, n in words.items()}
        for tokens, n in ends.items():
            keys = end_keys(list(tokens))
            for i, k in enumerate(keys):
                x = found.setdefault(k, [0, 0, keys[3] if i == 2 else None])
                x[0] += n
                x[1] += n * (i > 0)
        return [(k, *x) for k, x in found.items()]

    for text in texts:
        text = norm(text)
        if "\n" not in text and ". " not in text and "。" not in text:
            continue
        lines = lines_of(text)
        for j, line in enumerate(lines):
            sentences = [s for s in line.replace(". ", ".\n").replace("。", "。\n").split("\n") if s]
            for i, s in enumerate(sentences):
                tokens = tokens_of(s)
                if not tokens:
                    continue
                words.update(tokens)
                if j < len(lines) - 1 or i < len(sentences) - 1 or _STOPS.search(s):
                    ends[tuple(tokens[:2] + tokens[-3:]) if len(tokens) > 5 else tuple(tokens)] += 1
        if len(words) + len(ends) > 300_000:
            yield part()
            words.clear()
            ends.clear()
    yield part()


def truncation(text: str, task: str | None) -> bool | list[int]:
    """text: normalised. True or False where the text itself tells, else the keys of its end to be looked up."""
    text = text.strip()
    if _STOPS.search(text) and not text.endswith("..."):
        return unclosed(text) and text.count("(") - text.count(")") in (1, 2) and text.rfind("(") > text.rfind("\n")
    if unclosed(text):
        return True
    if _TAIL.search(text) and not _SECTIONS.search(text[-14:]) and len(text) > 3:
        return True
    sections = {m.group(1) for m in _SECTIONS.finditer(text)}
    if len(sections) >= 2 and sections <= {"title", "summary", "decisions", "actions", "open", "topics"} and "title" in sections and len(sections) < 6:
        return True
    lines = lines_of(text)
    if not lines:
        return False
    raw = [x.strip() for x in re.split(r"[\r\n]+", text) if x.strip()]
    head = _SECTIONS.match(lines[-1])
    if head and head.end() >= len(lines[-1].rstrip("*_ ")) and len(sections) >= 2 and raw[-1] not in _DASHES:  # a dash after a header says that there is nothing to report
        return True
    if len(raw) > 1 and raw[-1] in _DASHES and not _SECTIONS.match(_BULLET.sub("", raw[-2])):
        return True
    if not sections:
        keyed = [{m.group(1) for m in _KEYED.finditer(x)} for x in lines]
        labels = set().union(*keyed)
        if labels and not keyed[-1] >= (labels if len(lines) > 1 else {"owner", "task", "due"} & labels or labels):
            return True
        if {"owner", "task"} & labels:
            if not {"owner", "task", "due"} <= labels:
                return True
            value = list(_KEYED.finditer(lines[-1]))[-1]
            if value.group(1) != "due" or text[-1:] in _CLOSE:
                return False
            last = tokens_of(lines[-1])
            return [*end_keys(last)[:2], 0, 0]  # only whether a value may end so
    # The lines of the last section, or of the whole text, set the custom for a final stop.
    at = max((i for i, x in enumerate(lines) if _SECTIONS.match(x)), default=-1)
    own = [s for x in lines[at + 1 :] for s in x.replace(". ", ".\n").replace("。", "。\n").split("\n") if s.strip()]
    if len(own) > 1 and all(_STOPS.search(x) for x in own[:-1]):
        return True
    if text[-1:] in _CLOSE or head or lines[-1] in ("", "-"):
        return False
    last = tokens_of(own[-1] if own else lines[-1])
    if not last:
        return False
    return end_keys(last)


#: How rarely a word may end a unit and still end one; how few different last words there must be to one unit that starts alike, and how many more are reckoned with, unseen, before their ends are trusted.
RARE_END, SELDOM_END, FEW_ENDS, UNSEEN = 0.004, 0.1, 0.04, 1


def cut_off(e1, n1, e3, ns, ds):
    """On the looked-up counts of the last word (at an end, at all), of start with last word, and of the start (units, different last words). Columns or numbers."""
    return (e1 <= n1 * RARE_END) | ((e3 == 0) & (e1 <= n1 * SELDOM_END) & (ds > 0) & (ds + UNSEEN <= ns * FEW_ENDS))


def verdict(prompt: str | None, completion: str | None, due: str | None, task: str | None, model: residue.Letters | None) -> str | None | list[int]:
    if says_nothing(completion):
        return "empty"
    if residue.residue_kind(completion, model, prompt):
        return None
    text, asked = residue.bare(completion), norm(prompt)
    if is_refusal(text):
        return "refusal"
    if is_copied(asked, text):
        return "copied_prompt"
    if wrong_language(text, due):
        return "wrong_language"
    cut = truncation(text, task)
    return "truncated" if cut is True else (cut or None)


def find_defects(df: DataFrame) -> DataFrame:
    """(target_id, defect_type) of records with target_id, prompt, completion, lang, meta.tgt, task.

    A null completion is empty; a null prompt has nothing to copy; where neither
    meta.tgt nor lang is set, no language is due. Rows without target_id are left
    out. Two passes over the text: the first counts, over all records, how complete
    lines and sentences end; the second judges, and only ends that the text itself
    leaves open are looked up by a shuffled join.
    """
    model = residue.Letters(residue.letter_counts(df, "completion"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in end_counts(t for b in batches for t in b["c"]):
            yield pd.DataFrame(part, columns=["k", "e", "n", "g"]).astype({"g": "Int64"})

    counts = df.select(F.col("completion").alias("c")).mapInPandas(count, "k long, e long, n long, g long").groupBy("k").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.max("g").alias("g"))
    counts = durable(counts, "ends")
    starts = counts.filter("g is not null").groupBy(F.col("g").alias("k")).agg(F.count(F.lit(1)).alias("d"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p, c, due, task in zip(b["i"], b["p"], b["c"], b["due"], b["task"]):
                v = verdict(p, c, due, task, model)
                if v:
                    rows.append((i, v, None) if isinstance(v, str) else (i, None, v))
            if rows:
                yield pd.DataFrame(rows, columns=["i", "kind", "ends"])

    due = F.coalesce(F.nullif(F.col("meta.tgt"), F.lit("")), F.col("lang"))
    picked = df.select(F.col("target_id").cast("long").alias("i"), F.col("prompt").alias("p"), F.col("completion").alias("c"), due.alias("due"), F.col("task").alias("task")).filter("i is not null")
    judged = durable(picked.mapInPandas(judge, "i long, kind string, ends array<long>"), "defects")
    sure = judged.filter("kind is not null").select(F.col("i").alias("target_id"), F.col("kind").alias("defect_type"))
    asked = judged.filter("ends is not null").select("i", F.posexplode("ends").alias("at", "k"))
    at = lambda n, c: F.coalesce(F.max(F.when(F.col("at") == n, F.col(c))), F.lit(0))
    looked = asked.join(counts.drop("g"), "k", "left").join(starts, "k", "left").groupBy("i").agg(at(0, "e").alias("e1"), at(0, "n").alias("n1"), at(2, "e").alias("e3"), at(3, "n").alias("ns"), at(3, "d").alias("ds"))
    cut = cut_off(*(F.col(c) for c in ("e1", "n1", "e3", "ns", "ds")))
    return sure.unionByName(looked.filter(cut).select(F.col("i").alias("target_id"), F.lit("truncated").alias("defect_type"))).distinct()
