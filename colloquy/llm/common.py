"""Text helpers that several operators share. Kernels run in Arrow-fed Python workers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from re import _parser  # what the module itself parses patterns with

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

#: Lines of a transcript carry a clock and a label: "[0:05] S1: text".
CLOCK = r"[\[(<〔【]?\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?\s*[\])>〕】]?"
#: Begins with the class of its first signs, so that the search skips to them; so does FILLER.
STAMP = re.compile(
    r"[\[(<〔【\d](?:(?<!\d)\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\s*[\])>〕】]"
    r"|(?<=\d)\d?:\d{2}:\d{2}(?:[.,]\d{1,3}(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?|\s*-->\s*\d{1,2}:\d{2}:\d{2}))"
)
#: Notes on what was heard besides speech.
NOTE = re.compile(
    r"\(\([^()\n]{1,30}\)\)|\{[^{}\d\n]{1,30}\}|<[^<>\d\n]{1,30}>|\[[^\[\]\d\n]{1,30}\]|【[^【】\d\n]{1,20}】|〔[^〔〕\d\n]{1,20}〕"
    r"|\*[^*\d\n]{1,24}\*|♪[^♪\n]{0,30}♪"
    r"|[(（](?:laugh\w*|applause|cough\w*|sigh\w*|noise\w*|music|inaudible|crosstalk|silence|pause|clears throat|背景雜音|掌聲|笑聲|音樂|咳嗽|聽不清|雜音)[)）]",
    re.I,
)
#: Hesitations, and phrases put in between that say nothing.
FILLER = re.compile(
    r"[uUeEhHmMyYiIİı嗯呃欸就那](?:(?<![\w'].)(?i:(?<=u)u*h+[ -]huh|(?<=m)m+[ -]hmm+|(?<=u)u*h+|(?<=u)u*m+|(?<=e)e*r+m+|(?<=e)r|(?<=h)h*mm+|(?<=m)m+"
    r"|(?<=y)(?<!as y)ou know(?=\s*(?:,|\.\.\.|…|-|—))|(?<=i) mean(?=\s*(?:,|\.\.\.|…|-|—)))(?![\w'])[,.…]*"
    r"|(?<=[嗯呃欸])[嗯呃欸]*哼?[，、。…]*|(?:(?<=就)是說|(?<=那)個)(?:[，、]|……|…))",
    re.S,
)
LABEL = re.compile(r"^\s*(?:[-*•·–]\s*)?(?:S\d{1,3}|[A-Z][\w.'-]*(?: [A-Z#\d][\w.'-]*){0,3}|[一-鿿]{2,6})\s*[:：]\s*", re.M)
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
HAN = re.compile(r"[一-鿿]")


def norm(text: str | None) -> str:
    """Compatibility forms unified, case folded; null is empty."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.casefold()


_NOT_WORD = re.compile(r"[\W_]+")
_ASCII_REST = bytes(i for i in range(128) if not chr(i).isalnum())


def letters(text: str) -> str:
    """Only the letters and digits, in order."""
    if text.isascii():
        return text.encode().translate(None, _ASCII_REST).decode()
    return _NOT_WORD.sub("", text)


def map_pandas(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """mapInPandas for a kernel that takes one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = kernel(batch)
            if len(out):
                yield out

    return df.mapInPandas(run, schema)


def bounded(batches: Iterator[pd.DataFrame], column: str = "text", chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The batches in slices of whole rows with about so many characters each, so that a worker's memory does not depend on how long texts are; a text is never cut."""
    for b in batches:
        n = b[column].str.len().fillna(0).to_numpy()
        part = (n.cumsum() - n) // chars
        for k in pd.unique(part):
            yield b[part == k]


def required(pattern: re.Pattern) -> set[str]:
    """Literals of which every match of the pattern holds at least one, read off its parse; raises where there are none. For patterns that do not ignore case."""
    if pattern.flags & re.IGNORECASE:
        raise ValueError("literals of a pattern that ignores case are not fixed")
    found = _required(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE))
    if not found:
        raise ValueError(f"nothing is required by {pattern.pattern[:40]}")
    return found


def _required(parts: Iterable) -> set[str] | None:
    """Of a sequence the set whose shortest literal is the longest; None where nothing is required."""
    options, run = [], ""
    for op, value in [*parts, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            options.append({run})
            run = ""
        if op is _parser.BRANCH:
            each = [_required(x) for x in value[1]]
            if all(each):
                options.append(set().union(*each))
        elif op is _parser.SUBPATTERN and (inner := _required(value[3])):
            options.append(inner)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] >= 1 and (inner := _required(value[2])):
            single = len(value[2]) == 1 and value[2][0][0] is _parser.LITERAL
            options.append({x * value[0] for x in inner} if single else inner)
        elif op is _parser.IN and all(k is _parser.LITERAL for k, _ in value):
            options.append({chr(x) for _, x in value})
    return max(options, key=lambda x: (min(map(len, x)), -len(x)), default=None)


class Gate:
    """Which of some patterns a text can hold at all: those of whose required literals it holds one, found by one pass of an Aho-Corasick automaton. Exact: a pattern left out has no match in the text nor in any part of it."""

    def __init__(self, patterns: dict[str, re.Pattern]):
        self.names = list(patterns)
        words: dict[str, int] = {}
        for k, p in enumerate(patterns.values()):
            for w in required(p):
                words[w] = words.get(w, 0) | 1 << k
        self.automaton = ahocorasick.Automaton()
        for w, bits in words.items():
            self.automaton.add_word(w, bits)
        self.automaton.make_automaton()

    def may(self, text: str) -> dict[str, bool]:
        bits = 0
        for _, b in self.automaton.iter(text):
            bits |= b
        return {name: bool(bits >> k & 1) for k, name in enumerate(self.names)}
