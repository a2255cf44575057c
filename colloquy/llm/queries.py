"""The queries of the training-data operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import containers, copies, defects, leaks, mixture, overlap, pieces, pii, residue, turns
from colloquy.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _close(shares: DataFrame) -> DataFrame:
    """What each source should reach, and whether it does, to two hundredths, without repeating a document too often."""
    far = F.abs(F.col("actual_share") - F.col("reachable_share"))
    return shares.select("source", "target_share", F.round("reachable_share", 9).alias("reachable_share"), (far < 0.02).alias("reached"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: copies.find_copies(table(s, d, "targets")),
        "p1_groups": lambda s, d: copies.collapse_copies(table(s, d, "targets")),
        "p2_found": lambda s, d: defects.find_defects(table(s, d, "targets")),
        "p3_found": lambda s, d: turns.find_dirt(table(s, d, "meetings")),
        "p3_turns": lambda s, d: turns.clean_turns(table(s, d, "meetings")),
        "p4_found": lambda s, d: pieces.find_oversized(table(s, d, "meetings"), table(s, d, "size_limits")),
        "p4_pieces": lambda s, d: pieces.item_pieces(table(s, d, "meetings"), table(s, d, "size_limits")),
        "p5_found": lambda s, d: residue.find_residue(table(s, d, "targets")),
        "p6_found": lambda s, d: containers.find_cut_rows(table(s, d, "sft_rows"), table(s, d, "size_limits")),
        "p6_containers": lambda s, d: containers.pack_rows(table(s, d, "sft_rows"), table(s, d, "size_limits")),
        "p6_fill": lambda s, d: containers.fill_report(table(s, d, "sft_rows"), table(s, d, "size_limits")),
        "p6_checked": lambda s, d: containers.packing_check(table(s, d, "sft_rows"), table(s, d, "size_limits")),
        "p7_found": lambda s, d: overlap.find_overlaps(table(s, d, "meetings")).select("row_id_a", "row_id_b"),
        "p7_report": lambda s, d: overlap.overlap_report(table(s, d, "meetings")),
        "p8_found": lambda s, d: leaks.find_leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_report": lambda s, d: leaks.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixture.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_budget": lambda s, d: mixture.mix(table(s, d, "documents"), table(s, d, "mix_targets"), budget=1_000_000),
        "p9_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_checked": lambda s, d: _close(mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets"))),
        "p10_found": lambda s, d: pii.find_pii(table(s, d, "documents")),
        "p10_masked": lambda s, d: pii.mask_pii(table(s, d, "documents")),
    }


# White space as Python reads it, for RE2.
_SP = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _ends(mark: str, after: str) -> str:
    """Offsets at which matches of mark+after end, in text t: lengths summed up of the segments that each match ends."""
    return f"list_transform(range(1, len(g) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))) FROM (SELECT regexp_extract_all(t, '[^{mark}]*[{mark}]+{after}') AS g)"


_KINDS = {"utterance": (r"\n", ""), "sentence": (r".!?。！？…", f"[\"''”’」』)）]*[{_SP}]*"), "clause": (",;:，；：、", f"[{_SP}]*"), "word": (_SP, "")}
# An utterance ends at every line break, so its segments end with one.
_PIECES = f"""
    WITH RECURSIVE u AS (SELECT row_id, unnest(utterances).text AS x, generate_subscripts(utterances, 1) - 1 AS pos FROM meetings),
    items AS (SELECT 'meeting' AS item_kind, row_id, -1 AS pos, string_agg(coalesce(x, ''), chr(10) ORDER BY pos) AS t FROM u GROUP BY row_id UNION ALL SELECT 'utterance', row_id, pos, x FROM u),
    big AS (SELECT i.*, l.max_chars AS most, l.overlap_chars AS lap, length(t) AS n FROM items i JOIN size_limits l USING (item_kind) WHERE length(t) > l.max_chars),
    cuts AS (SELECT *, {", ".join(f"(SELECT {_ends(*x) if k != 'utterance' else _ends(*x).replace(']+', ']')}) AS {k}" for k, x in _KINDS.items())} FROM big),
    steps AS (SELECT item_kind, row_id, pos, -1 AS piece, 0 AS s, 0 AS e, '' AS cut FROM cuts
        UNION ALL
        SELECT c.item_kind, c.row_id, c.pos, p.piece + 1, p.s2, CASE WHEN c.n - p.s2 <= c.most THEN c.n ELSE coalesce(a.utterance, a.sentence, a.clause, a.word, p.s2 + c.most) END,
            CASE WHEN c.n - p.s2 <= c.most THEN 'end' WHEN a.utterance IS NOT NULL THEN 'utterance' WHEN a.sentence IS NOT NULL THEN 'sentence' WHEN a.clause IS NOT NULL THEN 'clause' WHEN a.word IS NOT NULL THEN 'word' ELSE 'hard' END
        FROM (SELECT *, CASE WHEN piece < 0 THEN 0 ELSE e - lap END AS s2 FROM (SELECT steps.*, cuts.lap FROM steps JOIN cuts USING (item_kind, row_id, pos)) WHERE cut <> 'end') p JOIN cuts c USING (item_kind, row_id, pos),
        LATERAL (SELECT {", ".join(f"list_max(list_filter(c.{k}, lambda o: o <= p.s2 + c.most AND o > greatest(p.e, p.s2 + c.lap))) AS {k}" for k in _KINDS)}) a)
    SELECT s.item_kind, s.row_id, CAST(s.pos AS INT) AS pos, CAST(piece AS INT) AS piece, CAST(CASE WHEN piece = 0 THEN 1 ELSE first + 1 END AS INT) AS start_pos, CAST(e AS INT) AS end_pos, cut, substr(t, CAST(first + 1 AS BIGINT), CAST(e - first AS BIGINT)) AS piece_text
    FROM (SELECT *, CASE WHEN piece = 0 THEN 0 ELSE lag(e) OVER (PARTITION BY item_kind, row_id, pos ORDER BY piece) - lap END AS first FROM steps JOIN (SELECT item_kind, row_id, pos, t, lap FROM big) USING (item_kind, row_id, pos)) s WHERE piece >= 0"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_pieces": _PIECES,
        "p4_found": """
            WITH u AS (SELECT row_id, unnest(utterances) AS u, generate_subscripts(utterances, 1) - 1 AS pos FROM meetings),
            one AS (SELECT 'utterance' AS item_kind, row_id, pos, length(u.text) AS n FROM u),
            whole AS (SELECT 'meeting' AS item_kind, row_id, -1 AS pos, sum(length(coalesce(u.text, ''))) + count(*) - 1 AS n FROM u GROUP BY row_id)
            SELECT DISTINCT x.item_kind, x.row_id, CAST(x.pos AS INT) AS pos
            FROM (SELECT * FROM one UNION ALL SELECT * FROM whole) x JOIN size_limits l ON x.item_kind = l.item_kind WHERE x.n > l.max_chars""",
        "p6_checked": """
            WITH m AS (SELECT row_id, unnest(messages) AS m FROM sft_rows), n AS (SELECT s.row_id, coalesce(sum(length(coalesce(m.m.content, ''))), 0) AS n FROM sft_rows s LEFT JOIN m ON m.row_id = s.row_id GROUP BY s.row_id)
            SELECT CAST(sum(greatest(1, ceil(n / (SELECT max_chars FROM size_limits WHERE item_kind = 'sft_container')))) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS chars, true AS once, true AS fits, true AS none_empty, true AS tight FROM n""",
        "p9_checked": """
            WITH h AS (SELECT t.source, t.target_share, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '' AND d.doc_id IS NOT NULL) AS has FROM mix_targets t)
            SELECT source, target_share, round(CASE WHEN has THEN target_share ELSE 0 END / sum(CASE WHEN has THEN target_share ELSE 0 END) OVER (), 9) AS reachable_share, true AS reached FROM h""",
        "p6_found": """
            WITH m AS (SELECT row_id, unnest(messages) AS m FROM sft_rows)
            SELECT row_id FROM m GROUP BY row_id
            HAVING sum(length(coalesce(m.content, ''))) > (SELECT max_chars FROM size_limits WHERE item_kind = 'sft_container')""",
    }
