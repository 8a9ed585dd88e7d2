"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glosswork.llm.hashing import text_chunks
from glosswork.llm.pretokens import PieceMemory

# Every token position is a row. A round joins each word's adjacent pairs with the merge table, finds the pair of
# least rank (the leftmost of equals), puts the merged token in its first place and drops its second; words
# without a pair left are done.
_ENCODE = """
WITH RECURSIVE steps AS (
  SELECT w, pos, tok, false AS done FROM start_rows
  UNION ALL
  (WITH neighbours AS (
     SELECT w, pos, tok, lead(tok) OVER word AS next_tok, lag(pos) OVER word AS previous_pos
     FROM steps WHERE NOT done WINDOW word AS (PARTITION BY w ORDER BY pos)),
   pairs AS (
     SELECT n.w, n.pos, n.tok, n.previous_pos, m.merged::BIGINT * 1099511627776 + n.pos AS rank_pos
     FROM neighbours n LEFT JOIN merges m ON m.first = n.tok AND m.second = n.next_tok),
   best AS (SELECT w, min(rank_pos) AS rank_pos FROM pairs GROUP BY w)
   SELECT p.w, p.pos, CASE WHEN p.rank_pos = b.rank_pos THEN (b.rank_pos // 1099511627776)::INTEGER ELSE p.tok END AS tok,
          b.rank_pos IS NULL AS done
   FROM pairs p JOIN best b ON p.w = b.w
   WHERE b.rank_pos IS NULL OR p.previous_pos IS DISTINCT FROM b.rank_pos % 1099511627776)
)
SELECT w, pos, tok FROM steps WHERE done ORDER BY w, pos
"""
# As above, for long pieces. A round takes the places of the least rank from left to right, overlaps aside (every other
# place of a run): one after the other they are the next rounds, as long as no pair of lesser rank arises beside a merged
# token. The place where one does (it stirs) is the last of its round. What stands beside a token when it is merged is
# what is left of it then, so the token itself where it was merged just before, and what is right of it now. A round
# hands on the rows that change alone, the second one of a merge without a token; the key keeps the last state of each.
_ENCODE_LONG = """
WITH RECURSIVE steps USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM start_rows
  UNION
  (WITH live AS (
     SELECT w, pos, tok, lag(tok) OVER word AS left_tok, lead(tok) OVER word AS next_tok, lead(tok, 2) OVER word AS right_tok,
       lead(pos) OVER word AS next_pos, row_number() OVER word AS place
     FROM recurring.steps WHERE tok IS NOT NULL AND w IN (SELECT w FROM steps) WINDOW word AS (PARTITION BY w ORDER BY pos)),
   pairs AS (SELECT l.*, m.merged, m.alone FROM live l JOIN merges m ON m.first = l.tok AND m.second = l.next_tok),
   hits AS (SELECT * FROM pairs QUALIFY merged = min(merged) OVER (PARTITION BY w)),
   runs AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY place) AS nth FROM hits),
   odd AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY w, place - nth ORDER BY place) % 2 = 1),
   beside AS (SELECT *, CASE WHEN lag(place) OVER in_order = place - 2 THEN merged ELSE left_tok END AS before FROM odd WINDOW in_order AS (PARTITION BY w ORDER BY place)),
   stirred AS (
     SELECT b.w, min(b.place) AS place FROM beside b
       LEFT JOIN merges x ON x.first = b.before AND x.second = b.merged LEFT JOIN merges y ON y.first = b.merged AND y.second = b.right_tok
     WHERE b.alone AND (x.merged < b.merged OR y.merged < b.merged) GROUP BY b.w),
   taken AS (SELECT b.* FROM beside b LEFT JOIN stirred s ON s.w = b.w WHERE s.place IS NULL OR b.place <= s.place)
   SELECT w, pos, merged AS tok FROM taken UNION ALL SELECT w, next_pos, NULL FROM taken)
)
SELECT w, pos, tok FROM steps WHERE tok IS NOT NULL ORDER BY w, pos
"""
_LONG = 64
_DECODE = """
SELECT t.w, unhex(string_agg(v.bytes_hex, '' ORDER BY t.pos)) AS decoded
FROM id_rows t JOIN vocabulary v ON v.id = t.tok GROUP BY t.w ORDER BY t.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n bytes."""
    found = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        found = found * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k] + np.uint64(1)
    return found


class DuckBpe:
    """The merge table and the vocabulary in an in-memory DuckDB, with what has been encoded so far."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        splits = [
            (first, second, merged)
            for token, merged in ranks.items()
            for i in range(1, len(token))
            if (first := ranks.get(token[:i])) is not None and (second := ranks.get(token[i:])) is not None
        ]
        first, second, merged = (np.array(x, np.int32) for x in zip(*splits, strict=True))
        alone = np.isin(merged, np.concatenate((first[merged < first], second[merged < second])))
        by_length: dict[int, list[bytes]] = {}
        for token in ranks:
            by_length.setdefault(len(token), []).append(token)
        self.token_hashes = {n: np.sort(_hashes(np.frombuffer(b"".join(t), np.uint8), n)[::n]) for n, t in by_length.items() if n > 1}
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '400MB'")
        self.con.execute("SET temp_directory = ''")  # never a folder of the machine
        self._load("merges", pa.table({"first": first, "second": second, "merged": merged, "alone": alone}))
        self._load("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes_hex": [t.hex() for t in ranks]}))
        self.memory = PieceMemory(self.ids_and_bytes, ["<u4", "u1"])

    def _load(self, name: str, table: pa.Table) -> None:
        self.con.register("loading", table)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.con.unregister("loading")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.con.register(name, rows)
        result = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return result

    def _cut(self, piece: bytes) -> list[int]:
        """Where no occurrence of a token reaches across: merges on one side of such a place never meet the other side.

        A clash of hashes only leaves a place out.
        """
        data = np.frombuffer(piece, np.uint8)
        spans = np.zeros(len(data) + 1, np.int64)
        for n, known in self.token_hashes.items():
            if n <= len(data):
                at = np.flatnonzero(np.isin(_hashes(data, n), known))
                spans[at + 1] += 1
                np.subtract.at(spans, at + n, 1)
        return [0, *(np.flatnonzero(np.cumsum(spans)[1:-1] == 0) + 1).tolist(), len(data)]

    def encode(self, pieces: list[bytes]) -> pa.Table:
        """(w, pos, tok): the tokens of each non-empty piece, whose number is w, in order.

        Pieces of more than ``_LONG`` bytes are cut where no token reaches across.
        """
        parts, owner, shift = [], [], []
        for w, piece in enumerate(pieces):
            for a, b in pairwise(self._cut(piece) if len(piece) > _LONG else [0, len(piece)]):
                parts.append(piece[a:b])
                owner.append(w)
                shift.append(a)
        owner, shift = np.array(owner, np.int32), np.array(shift, np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        tok = self.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        part = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        found = []
        for long, sql in ((False, _ENCODE), (True, _ENCODE_LONG)):
            rows = (lengths > _LONG)[part] == long
            if rows.any():
                found.append(self._query("start_rows", pa.table({"w": part[rows], "pos": pos[rows], "tok": tok[rows]}), sql))
        if not found:
            return pa.table({"w": pa.array([], pa.int32()), "pos": pa.array([], pa.int64()), "tok": pa.array([], pa.int32())})
        rows = pa.concat_tables(found)
        part, pos, tok = (rows[c].to_numpy() for c in ("w", "pos", "tok"))
        if len(found) > 1:
            order = np.argsort(part, kind="stable")
            part, pos, tok = part[order], pos[order], tok[order]
        return pa.table({"w": owner[part], "pos": pos + shift[part], "tok": tok})

    def decode(self, rows: pa.Table) -> list[bytes]:
        """The bytes of each run w of (w, pos, tok), in order of w; an unknown id raises ValueError."""
        decoded = self._query("id_rows", rows, _DECODE)
        known = self.con.execute("SELECT max(id) FROM vocabulary").fetchall()[0][0]
        tok = rows["tok"].to_numpy()
        if len(tok) and (tok.min() < 0 or tok.max() > known):
            raise ValueError("an id is not in the vocabulary")
        return decoded["decoded"].to_pylist()

    def ids_and_bytes(self, words: list[str]) -> list[list[bytes]]:
        """The ids of each word as little-endian numbers, and the bytes that these ids decode to."""
        ids, back = [], []
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            rows = self.encode([w.encode("utf-8", "surrogatepass") for w in part])
            back += self.decode(rows)
            packed = rows["tok"].to_numpy().astype("<u4").tobytes()
            ends = [0, *(4 * np.cumsum(np.bincount(rows["w"].to_numpy(), minlength=len(part)))).tolist()]
            ids += [packed[a:b] for a, b in pairwise(ends)]
        return [ids, back]


_ENGINES: dict[str, DuckBpe] = {}


def engine(path: str) -> DuckBpe:
    """The engine of this Python worker for a rank file, made once."""
    if path not in _ENGINES:
        _ENGINES[path] = DuckBpe(path)
    return _ENGINES[path]


def encode_documents(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256) of every row's whole text; ``ids`` is null without ``with_ids``.

    Each match of the public pattern is encoded on its own, without special tokens. A null text is empty: no ids and
    the digests of nothing. Texts are handled in chunks of about four million characters; the distinct words of a
    chunk that the worker has not met yet become one recursive query, and decoding joins the ids with the
    vocabulary again. Repeated rows stay; other columns are not read. ``rank_path`` must exist on every worker. A
    short word of n bytes takes up to n rounds over n rows. A long one is cut where no token reaches across, and a round
    takes all places of its least rank up to one that stirs, so that it mostly takes as many rounds as it has distinct merges.
    """
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(thin.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(rank_path)
        for batch in batches:
            ids, n, encoded, decoded = [], [], [], []
            for texts in text_chunks(batch.column(1), 1 << 22):
                for packed, back in bpe.memory.join(texts):
                    n.append(len(packed) // 4)
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32) if with_ids else None)
                    encoded.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return thin.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, rank_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded: binary): the bytes of each row's ids, by an ordered aggregation in DuckDB. Null or no ids give b''."""
    thin = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(thin.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(rank_path)
        for batch in batches:
            lists = [np.asarray(x.as_py() or [], np.int32) for x in batch.column(1)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            tok = np.concatenate([*lists, np.zeros(0, np.int32)])
            rows = pa.table({"w": np.repeat(np.arange(len(lists), dtype=np.int32), lengths), "pos": np.arange(len(tok)), "tok": tok})
            found = dict(zip(np.flatnonzero(lengths).tolist(), bpe.decode(rows), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found.get(i, b"") for i in range(len(lists))], pa.binary())], names=["id", "decoded"])

    return thin.mapInArrow(run, f"id {kind}, decoded binary")
