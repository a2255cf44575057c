"""Problem 7: meetings of the val and test splits that also stand in the train split.

Texts are normalised to token sequences; equal sequences form a class, and only
class representatives are compared. The evaluation classes are cut into passages,
consecutive runs of tokens, and sharded by volume. Every training class meets every
shard where it lies: a sieve counts the passages of each record that stand in the text
and leaves the records that can be the same meeting at all, an exact condition. The
passages of those make an Aho-Corasick automaton over tokens, which scans the text:
all that stand in it come out in one traversal. They are
chained in order, merged into intervals, and measured as coverage of both texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import FILLER, HAN, LABEL, NOTE, STAMP, WORD, norm
from colloquy.session import durable

#: Tokens in a passage, for words and for Han characters.
PASSAGE = {False: 5, True: 8}
#: Least coverage of both texts for the same meeting: about two thirds less what edits of single words take from whole passages.
COVERAGE = 0.44
#: Passages between two matched ones that may count as edited, so that matched ones are at least 1 / (BRIDGE + 1) of those covered.
BRIDGE = 3
#: Tokens of evaluation records in one shard, which every worker holds with its sieve, about 10 bytes for each.
SHARD = 10_000_000
#: Tokens of the records in one automaton, about 40 bytes for each.
AUTOMATON = 2_000_000
#: Records of a shard from which a passage is common.
COMMON = 5

SPLIT_NAMES = {"train": "train", "val": "val", "dev": "val", "validation": "val", "valid": "val", "test": "test"}


def split_name(column: str = "split") -> F.Column:
    """train, val or test, whatever the spelling; others are null."""
    c = F.lower(F.trim(F.col(column)))
    out = F.lit(None).cast("string")
    for name, means in SPLIT_NAMES.items():
        out = F.when(c == name, means).otherwise(out)
    return out


#: All but letters and digits as spaces: what WORD finds in a text without other signs.
_SPACED = bytes(i if chr(i).isalnum() and i < 128 else 32 for i in range(256))
_TIME = re.compile(r"\W{0,3}(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,]\d{1,3})?(?:\W|$)")


def in_time(texts: list[str]) -> list[str]:
    """Lines whose mark is earlier than one before them stand where their time belongs; lines without mark stay behind the one before."""
    keys, peak, moved = [], -1, False
    for t in texts:
        m = _TIME.match(t) if ":" in t[:8] else None
        at = int(m.group(1) or 0) * 3600 + int(m.group(2)) * 60 + int(m.group(3)) if m and not t[0].isdigit() or m and m.group(1) else peak
        moved |= at < peak
        peak = max(peak, at)
        keys.append(at)
    return [t for _, t in sorted(zip(keys, texts), key=lambda x: x[0])] if moved else texts


def tokens(texts: list[str | None]) -> list[str]:
    """Of a meeting's utterances in order of time, without marks of time, notes, fillers and labels in the text."""
    text = "\n".join(in_time([t for t in texts if t]))
    text = STAMP.sub(" ", text) if ":" in text else text
    text = NOTE.sub(" ", text)
    text = LABEL.sub(" ", text)
    text = FILLER.sub(" ", text)
    text = norm(text)
    return text.encode().translate(_SPACED).decode().split() if text.isascii() else WORD.findall(text)


def is_han(words: list[str]) -> bool:
    sample = words[:: max(1, len(words) // 64)]
    return sum(bool(HAN.match(w)) for w in sample) * 2 > len(sample)


def passages(words: list, size: int) -> list[tuple]:
    """The consecutive passages of a record; the last one ends with the record, and so may overlap with the one before."""
    if len(words) <= size:
        return [tuple(words)]
    starts = [*range(0, len(words) - size, size), len(words) - size]
    return [tuple(words[s : s + size]) for s in starts]


def coverage(hits: dict[int, list[int]], n: int, size: int, length: int) -> tuple[float, float]:
    """(of the record, of the text): shares of passages, and of tokens, matched in order.

    hits: of each matched passage's number the places of its last token in the text;
    n passages of so many tokens; length of the text in tokens. A passage between two
    matched ones that stand as far apart in the text as in the record counts as
    edited, not as missing.
    """
    if not hits or not n:
        return 0.0, 0.0
    # Longest chain with both passage number and place increasing.
    tops: list[int] = []
    links: list[tuple[int, int, int]] = []  # number, place, link before
    at_top: list[int] = []
    for i in sorted(hits):
        for place in sorted(hits[i], reverse=True):
            k = bisect_left(tops, place)
            links.append((i, place, at_top[k - 1] if k else -1))
            if k == len(tops):
                tops.append(place)
                at_top.append(len(links) - 1)
            else:
                tops[k], at_top[k] = place, len(links) - 1
    chain, at = [], at_top[-1]
    while at >= 0:
        i, place, at = links[at]
        chain.append((i, place))
    chain.reverse()
    got = len(chain)
    for (i, p), (j, q) in zip(chain, chain[1:]):
        if 1 < j - i <= BRIDGE + 1 and abs(q - p - (j - i) * size) <= 3 + 2 * (j - i):
            got += j - i - 1
    return got / n, min(1.0, got * size / length)


class Shard:
    """The automaton of the passages of some evaluation records: (class, token codes, whether Han) each."""

    def __init__(self, records: list[tuple[int, np.ndarray, bool]]):
        self.classes = [c for c, _, _ in records]
        self.size = np.array([PASSAGE[han] for _, _, han in records], dtype=np.int64)
        self.n = np.empty(len(records), dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        owner: list[int] = []
        which: list[int] = []
        number: list[int] = []
        for r, (_, codes, han) in enumerate(records):
            parts = passages(codes.tolist(), PASSAGE[han])
            self.n[r] = len(parts)
            for k, p in enumerate(parts):
                which.append(w := self.automaton.get(p, -1))
                if w < 0:
                    which[-1] = w = len(self.automaton)
                    self.automaton.add_word(p, w)
                owner.append(r)
                number.append(k)
        self.automaton.make_automaton()
        # Owners and numbers of each distinct passage, one after the other.
        order = np.argsort(which, kind="stable")
        self.owner = np.array(owner, dtype=np.int32)[order]
        self.number = np.array(number, dtype=np.int32)[order]
        self.first = np.searchsorted(np.array(which, dtype=np.int64)[order], np.arange(len(self.automaton) + 1))

    def scan(self, codes: list[int]) -> Iterator[tuple[int, float, float]]:
        """(class, coverage of the record, coverage of the text) of the records for which both can reach COVERAGE."""
        found = list(self.automaton.iter(tuple(codes)))
        if not found:
            return
        ends, which = np.array(found, dtype=np.int64).T
        distinct = np.unique(which)
        low, n = self.first[distinct], self.first[distinct + 1] - self.first[distinct]
        each = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[each], minlength=len(self.n))
        # Exact necessary conditions: every matched passage but the last bridges BRIDGE others at most.
        most = shared * (BRIDGE + 1) - BRIDGE + 1e-6
        likely = np.flatnonzero((most >= COVERAGE * self.n) & (most * self.size >= COVERAGE * len(codes)) & (self.n * self.size >= COVERAGE * len(codes)))
        if not len(likely):
            return
        wanted = np.zeros(len(self.n), dtype=bool)
        wanted[likely] = True
        hits: dict[int, dict[int, list[int]]] = {int(r): {} for r in likely}
        low, n = self.first[which], self.first[which + 1] - self.first[which]
        each = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        mine = wanted[self.owner[each]]
        for r, k, end in zip(self.owner[each[mine]].tolist(), self.number[each[mine]].tolist(), np.repeat(ends, n)[mine].tolist()):
            hits[r].setdefault(k, []).append(end)
        for r, own in hits.items():
            yield self.classes[r], *coverage(own, int(self.n[r]), int(self.size[r]), len(codes))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64 bits of each run of so many tokens, by its first one; equal runs have equal ones."""
    n = max(0, len(codes) - width + 1)
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    h = x[:n] + np.uint64(width)
    for j in range(1, width):
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += x[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h


class Sieve:
    """Tells which of some evaluation records a text can be a telling of at all, by counting the passages that it holds. Exact: hashes that collide only let more pass.

    A chain of c passages covers 4 c - 3 at most (BRIDGE), so COVERAGE asks for a least
    c. Of the passages of a record that many others hold too, fewer than that least
    number are not looked up, and the number asked for is less by as many.
    """

    def __init__(self, records: list[tuple[int, np.ndarray, bool]]):
        own = np.array([len(x) for _, x, _ in records], dtype=np.int64)
        self.size = np.array([PASSAGE[han] for _, _, han in records], dtype=np.int64)
        self.n = -(-own // self.size)
        codes = np.concatenate([x for _, x, _ in records]) if records else np.empty(0, dtype=np.int32)
        owner = np.repeat(np.arange(len(records)), self.n)
        first = np.cumsum(self.n) - self.n
        # As passages() cuts them.
        start = np.minimum((np.arange(len(owner)) - first[owner]) * self.size[owner], (own - self.size)[owner])
        start = np.maximum(start, 0) + (np.cumsum(own) - own)[owner]
        width = np.minimum(self.size, own)[owner]
        self.widths = np.unique(width).tolist()
        hashes = np.empty(len(owner), dtype=np.uint64)
        for w in self.widths:
            at = width == w
            hashes[at] = window_hashes(codes, w)[start[at]]
        self.hashes, which, often = np.unique(hashes, return_inverse=True, return_counts=True)
        least = self.least(self.n)
        order = np.lexsort((-often[which], owner))
        rank = np.empty(len(owner), dtype=np.int64)
        rank[order] = np.arange(len(owner)) - first[owner[order]]
        left_out = (rank < ((least - 1) * 2 // 3)[owner]) & (often[which] >= COMMON)
        self.spared = np.bincount(owner[left_out], minlength=len(records))
        self.need = least - self.spared
        owner, which = owner[~left_out], which[~left_out]
        order = np.argsort(which, kind="stable")
        self.owner = owner[order].astype(np.int32)
        self.first = np.searchsorted(which[order], np.arange(len(self.hashes) + 1))
        # Nearly all other windows are told by a table without a search.
        self.shift = np.uint64(64 - min(25, max(10, (16 * len(self.hashes)).bit_length())))
        self.seen = np.zeros(1 << 64 - int(self.shift), dtype=bool)
        self.seen[self.hashes[np.diff(self.first) > 0] >> self.shift] = True

    @staticmethod
    def least(units: np.ndarray) -> np.ndarray:
        """Passages that a chain must hold to cover COVERAGE of so many."""
        return np.ceil((COVERAGE * units + BRIDGE) / (BRIDGE + 1) - 1e-6).astype(np.int64)

    def likely(self, texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(place of a text, places of records) for the texts that may reach COVERAGE with some record."""
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // 200_000
        for k in np.unique(part):
            a, z = np.searchsorted(part, [k, k + 1])
            for t, records in self._likely(texts[a:z], sizes[a:z]):
                yield int(a) + t, records

    def _likely(self, texts: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        codes, text = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # tokens from each to the end of its text
        short = sizes[text] * COVERAGE <= max(PASSAGE.values())
        pairs = []
        for w in self.widths:
            h = window_hashes(codes, w)
            # Records of less than a passage cannot cover enough of longer texts.
            may = self.seen[h >> self.shift] & (left[: len(h)] >= w) & (short[: len(h)] | (w in PASSAGE.values()))
            at = np.flatnonzero(may)
            h = h[at]
            i = np.searchsorted(self.hashes, h)
            i[i == len(self.hashes)] = 0
            same = self.hashes[i] == h
            pairs.append(text[at[same]] * len(self.hashes) + i[same])
        pair = np.unique(np.concatenate(pairs))
        t, i = np.divmod(pair, len(self.hashes))
        n = self.first[i + 1] - self.first[i]
        owner = self.owner[np.repeat(self.first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(np.bincount(t, weights=n, minlength=len(texts)).astype(np.int64))])
        for k, length in enumerate(sizes.tolist()):
            if ends[k] == ends[k + 1]:
                continue
            shared = np.bincount(owner[ends[k] : ends[k + 1]], minlength=len(self.n))
            found = np.flatnonzero(shared >= self.need)
            size = self.size[found]
            found = found[(shared[found] + self.spared[found] >= self.least(length / size)) & (self.n[found] * size >= COVERAGE * length - 1e-6)]
            if len(found):
                yield k, found


_made: dict[str, Sieve] = {}


def sieve_of(name: str, records: list[tuple[int, bytes, bool]]) -> Sieve:
    """Built once per worker, which keeps the last one."""
    if name not in _made:
        _made.clear()
        _made[name] = Sieve([(c, np.frombuffer(x, dtype=np.int32), han) for c, x, han in records])
    return _made[name]


def covered_texts(ids: list[int], texts: list[np.ndarray], records: list[tuple[int, bytes, bool]], sieve: Sieve) -> Iterator[tuple[int, int, float]]:
    """(e, t, coverage) of the records and texts that reach COVERAGE, each text scanned by the automaton of the records that the sieve leaves for it and its neighbours."""
    block: list[int] = []
    wanted: set[int] = set()
    size = 0

    def scanned() -> Iterator[tuple[int, int, float]]:
        shard = Shard([(records[r][0], np.frombuffer(records[r][1], dtype=np.int32), records[r][2]) for r in sorted(wanted)])
        for k in block:
            for e, a, z in shard.scan(texts[k].tolist()):
                if e != ids[k] and min(a, z) >= COVERAGE:
                    yield e, ids[k], min(a, z)

    for k, found in sieve.likely(texts):
        new = set(found.tolist()) - wanted
        block.append(k)
        wanted |= new
        size += sum(len(records[r][1]) // 4 for r in new)
        if size >= AUTOMATON:
            yield from scanned()
            block, wanted, size = [], set(), 0
    if block:
        yield from scanned()


def overlapping_classes(classes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(e, t, coverage) for pairs of an evaluation and another, a training class; classes: c, in_eval, in_train, han, codes.

    Evaluation classes pass the driver in shards of bounded volume, one at a time; the
    training classes are only scanned, never moved. Hits are written before the next
    shard is made, so neither driver nor workers hold more than one.
    """
    spark = classes.sparkSession
    texts = classes.filter("in_train").select(F.col("c").alias("t"), "codes")
    out: list[DataFrame] = []

    def run(records: list[tuple[int, bytes, bool]], number: str) -> None:
        shared = spark.sparkContext.broadcast(records)

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and shared.value:
                    rows = covered_texts(b["t"].tolist(), [np.frombuffer(x, dtype=np.int32) for x in b["codes"]], shared.value, sieve_of(number, shared.value))
                    yield pd.DataFrame(list(rows), columns=["e", "t", "coverage"])

        out.append(durable(texts.mapInPandas(kernel, "e long, t long, coverage double"), "hits"))
        shared.destroy()

    block: list[tuple[int, bytes, bool]] = []
    size = 0
    for r in classes.filter("in_eval").select("c", "codes", "han").toLocalIterator():
        block.append((r["c"], bytes(r["codes"]), r["han"]))
        size += len(r["codes"]) // 4
        if size >= shard:
            run(block, uuid.uuid4().hex)
            block, size = [], 0
    if block or not out:
        run(block, uuid.uuid4().hex)
    return reduce(DataFrame.unionByName, out)


def normalised(meetings: DataFrame) -> DataFrame:
    """(row_id, split, source, cls, han, codes), one row per stored row with row_id and a known split; meetings without words are left out. codes: 31 bits of a checksum of each token, as bytes."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[str, int] = {}
        for b in batches:
            out = []
            for row, split, source, texts in zip(b["row_id"], b["split"], b["source"], b["texts"]):
                words = tokens(list(texts) if texts is not None else [])
                if words:
                    known = [ids.get(x) for x in words]
                    if None in known:
                        for i, x in enumerate(words):
                            if known[i] is None:
                                known[i] = ids[x] = zlib.crc32(x.encode()) & 0x7FFFFFFF
                    cls = blake2b(" ".join(words).encode(), digest_size=16).digest()
                    out.append((row, split, source, cls, is_han(words), np.array(known, dtype=np.int32).tobytes()))
            if len(ids) > 2_000_000:
                ids.clear()
            if out:
                yield pd.DataFrame(out, columns=["row_id", "split", "source", "cls", "han", "codes"])

    rows = meetings.select(F.col("row_id").cast("long"), split_name().alias("split"), "source", F.transform("utterances", lambda u: u["text"]).alias("texts"))
    return rows.filter("row_id is not null and split is not null").mapInPandas(kernel, "row_id long, split string, source string, cls binary, han boolean, codes binary")


def overlaps(meetings: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (e, t, coverage), and their members (c, row_id, split, source): a class is called by its smallest row.

    Each row is in one class, whatever number of copies it has, and copies are not
    expanded. Of rows that share a row_id, taken for repeats, one is kept.
    """
    rows = durable(normalised(meetings), "meetings")
    narrow = rows.groupBy("row_id").agg(F.min(F.struct("cls", "split", "source")).alias("x")).select("row_id", "x.*")
    sides = durable(narrow.groupBy("cls").agg(F.min("row_id").alias("c"), F.max(F.col("split") != "train").alias("in_eval"), F.max(F.col("split") == "train").alias("in_train")), "sides")
    first = rows.select(F.col("row_id").alias("c"), F.col("cls").alias("own"), "han", "codes")
    classes = durable(sides.join(first, "c").filter(F.col("cls") == F.col("own")).dropDuplicates(["c"]).select("c", "in_eval", "in_train", "han", "codes"), "classes")
    same = sides.filter("in_eval and in_train").select(F.col("c").alias("e"), F.col("c").alias("t"), F.lit(1.0).alias("coverage"))
    pairs = durable(overlapping_classes(classes, shard).unionByName(same), "pairs")
    return pairs, durable(narrow.join(sides.select("cls", "c"), "cls").drop("cls"), "members")


def find_overlaps(meetings: DataFrame, shard: int = SHARD) -> DataFrame:
    """(row_id_a, row_id_b, split, source, coverage): each pair of a train row and a val or test row that hold the same meeting.

    row_id_a is the smaller; split and source are those of the evaluation row. Rows of
    equal words overlap wholly. Every stored row counts; this is overlaps() with the
    members of both classes put in their place, as large as there are pairs of rows.
    """
    pairs, members = overlaps(meetings, shard)
    held = members.filter("split <> 'train'").select(F.col("c").alias("e"), F.col("row_id").alias("i"), "split", "source")
    train = members.filter("split = 'train'").select(F.col("c").alias("t"), F.col("row_id").alias("j"))
    return pairs.join(held, "e").join(train, "t").select(F.least("i", "j").alias("row_id_a"), F.greatest("i", "j").alias("row_id_b"), "split", "source", "coverage")


def overlap_report(meetings: DataFrame) -> DataFrame:
    """(split, source, rows, overlapping, pairs): per split and source of the evaluation rows. Pairs are counted from the sizes of the classes, not expanded."""
    pairs, members = overlaps(meetings)
    train = members.filter("split = 'train'").groupBy(F.col("c").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    partners = pairs.join(train, "t").groupBy(F.col("e").alias("c")).agg(F.sum("n").alias("n"))
    held = members.filter("split <> 'train'").groupBy("c", "split", "source").agg(F.count(F.lit(1)).alias("own"))
    hit = held.join(partners, "c").groupBy("split", "source").agg(F.sum("own").alias("overlapping"), F.sum(F.col("own") * F.col("n")).alias("pairs"))
    total = meetings.select("row_id", split_name().alias("split"), "source").filter("split in ('val', 'test')").groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"))
    same = total["split"].eqNullSafe(hit["split"]) & total["source"].eqNullSafe(hit["source"])
    return total.join(hit, same, "left").select(total["split"], total["source"], "rows", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
