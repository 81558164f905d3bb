"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

A text is cut by the vocabulary's split pattern. A piece that is a token is that token; of the
others each distinct one is encoded once while a worker remembers it. A recursive query holds one
row per (piece, position, token), joins neighbouring tokens with the merge table, contracts each
piece's leftmost pair of least rank and goes on with the pieces that changed until none does.

Pieces beyond ``SHORT`` bytes take a second form of the query, with the same results, for its
memory and rounds: only contracted positions are written back (the recursion is keyed by piece
and position), and where no merge that contains the new token has a smaller rank than the token
itself, all its occurrences in the piece are contracted in one round, left to right, since the
one-by-one order would take them next anyway. Decoding joins token rows with the vocabulary and
concatenates by an ordered aggregation.

The ranks are read once on the driver from a path that is a parameter and broadcast; a vocabulary
file is some hundred thousand rows whatever the corpus is (``VOCAB_BYTES`` bounds it).

Defined cases: null and empty texts have no tokens and decode to nothing (``decode`` keeps a null
list null). Rows are encoded one by one: repeated rows get equal results, a null id stays null, an
empty table gives an empty result. ``encode`` and ``decode`` keep all columns and add theirs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterkit.llm.common import blocks, fields, kept_state, map_arrow, texts_of

VOCAB_BYTES = 64 << 20
CHUNK_BYTES = 256 << 10  # of distinct pieces in one recursive query; a longer piece stands alone
CACHE_BYTES = 60 << 20  # of remembered pieces with their ids and bytes, twice at most, unless a caller asks for less
SHORT = 64
BLOCK = 4 << 20  # bytes of text whose new pieces go into the queries together
DECODE = """
SELECT s.row, string_agg(v.hex, '' ORDER BY s.pos) FROM
  (SELECT row, unnest(ids) id, generate_subscripts(ids, 1) pos FROM coded) s JOIN vocab v USING (id) GROUP BY s.row"""
ENCODE = """
WITH RECURSIVE t(piece, pos, tok, done) AS (
  SELECT piece, pos, tok, false FROM pieces
  UNION ALL
  (WITH pair AS (
     SELECT piece, pos, tok, lead(tok) OVER w nxt, lead(pos) OVER w nxt_pos FROM t
     WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)),
   best AS (
     SELECT piece, min(id::BIGINT << 32 | pos) least, arg_min(nxt_pos, id::BIGINT << 32 | pos) gone
     FROM pair JOIN merges ON tok = left_id AND nxt = right_id GROUP BY piece)
   SELECT piece, pos, CASE WHEN pos = least & 4294967295 THEN (least >> 32)::INT ELSE tok END, least IS NULL
   FROM pair LEFT JOIN best USING (piece) WHERE pos IS DISTINCT FROM gone))
SELECT piece, tok FROM t WHERE done ORDER BY piece, pos"""
ENCODE_LONG = """
WITH RECURSIVE t(piece, pos, tok) USING KEY (piece, pos) AS (
  SELECT piece::INT, pos::INT, tok::INT FROM pieces
  UNION
  (WITH pair AS (
     SELECT piece, pos, tok, lead(tok) OVER w nxt, lead(pos) OVER w nxt_pos FROM recurring.t
     WHERE tok >= 0 AND piece IN (SELECT piece FROM t) WINDOW w AS (PARTITION BY piece ORDER BY pos)),
   found AS (
     SELECT piece, pos, nxt_pos, id, alone, tok = nxt AS twin FROM pair JOIN merges ON tok = left_id AND nxt = right_id),
   best AS (SELECT piece, min(id::BIGINT << 32 | pos) least FROM found GROUP BY piece),
   pick AS (
     SELECT piece, pos, nxt_pos, id, twin FROM found JOIN best USING (piece)
     WHERE id = least >> 32 AND (NOT alone OR pos = least & 4294967295)),
   chain AS (SELECT *, lag(nxt_pos) OVER (PARTITION BY piece ORDER BY pos) IS DISTINCT FROM pos AS opens FROM pick WHERE twin),
   run AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY piece ORDER BY pos) AS nr FROM chain),
   odd AS (SELECT *, row_number() OVER (PARTITION BY piece, nr ORDER BY pos) % 2 = 1 AS taken FROM run),
   done AS (
     SELECT piece, pos, nxt_pos, id FROM pick WHERE NOT twin
     UNION ALL SELECT piece, pos, nxt_pos, id FROM odd WHERE taken)
   SELECT piece, pos, id FROM done UNION ALL SELECT piece, nxt_pos, -1 FROM done))
SELECT piece, tok FROM t WHERE tok >= 0 ORDER BY piece, pos"""


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """The vocabulary and its merges as DuckDB tables, and the pieces encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int | None = None):
        import duckdb
        import pandas as pd
        import regex

        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges, least = [], {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    merges.append((left, right, rank))
                    least[left] = min(least.get(left, rank), rank)
                    least[right] = min(least.get(right, rank), rank)
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "700MB"})
        rows = pd.DataFrame(merges, columns=["left_id", "right_id", "id"], dtype="int32")
        rows["alone"] = [least.get(i, i + 1) <= i for i in rows["id"]]  # contract one at a time
        self.db.execute("CREATE TABLE merges AS SELECT * FROM rows")
        known = pd.DataFrame({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]})
        self.db.execute("CREATE TABLE vocab AS SELECT id::INT id, hex FROM known")
        self.ranks = ranks
        self.cache_bytes = cache_bytes
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.size = 0

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece (none of them empty)."""
        raw = [p.encode() for p in pieces]
        out: list = [None] * len(raw)
        rest = []
        for i, r in enumerate(raw):
            if r in self.ranks:
                out[i] = [self.ranks[r]]
            else:
                rest.append(i)
        for query, some in ((ENCODE, [i for i in rest if len(raw[i]) <= SHORT]), (ENCODE_LONG, [i for i in rest if len(raw[i]) > SHORT])):
            start = 0
            while start < len(some):
                stop, size = start, 0
                while stop < len(some) and (stop == start or size + len(raw[some[stop]]) <= CHUNK_BYTES):
                    size += len(raw[some[stop]])
                    stop += 1
                for i, ids in zip(some[start:stop], self._contract(query, [raw[i] for i in some[start:stop]])):
                    out[i] = ids
                start = stop
        return out

    def _contract(self, query: str, part: list[bytes]) -> list[list[int]]:
        n = np.fromiter(map(len, part), np.int64, len(part))
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows = {"piece": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": at.astype(np.int32), "tok": self.byte_id[np.frombuffer(b"".join(part), np.uint8)]}
        self.db.register("pieces", pa.table(rows))
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("pieces")
        return [x.tolist() for x in np.split(got["tok"], np.flatnonzero(np.diff(got["piece"])) + 1)]

    def decode_rows(self, ids: list) -> list[bytes]:
        """The bytes of each list of ids; unknown ids raise."""
        out = [b""] * len(ids)
        start = 0
        while start < len(ids):
            stop, size = start, 0
            while stop < len(ids) and (stop == start or size + len(ids[stop]) <= CHUNK_BYTES):
                size += len(ids[stop])
                stop += 1
            part = ids[start:stop]
            self.db.register("coded", pa.table({"row": np.arange(len(part)), "ids": pa.array(part, pa.list_(pa.int32()))}))
            for row, text in self.db.execute(DECODE).fetchall():
                out[start + row] = bytes.fromhex(text)
            self.db.unregister("coded")
            start = stop
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Have all the pieces in the cache. What was not used for a whole cache's length is forgotten."""
        if self.size > (self.cache_bytes or CACHE_BYTES):
            self.older, self.cache, self.size = self.cache, {}, 0
        new = []
        for p in dict.fromkeys(pieces):
            if p not in self.cache:
                if p in self.older:
                    self.cache[p] = self.older[p]
                    self.size += 4 * len(p) + 200
                else:
                    new.append(p)
        if new:
            coded = self.encode_pieces(new)
            self.cache.update(zip(new, zip(map(len, coded), (" ".join(map(str, ids)) for ids in coded), self.decode_rows(coded))))
            self.size += sum(8 * len(p) + 300 for p in new)

    def close(self) -> None:
        self.db.close()

    def pieces_of(self, text: str) -> list[str]:
        return self.split(text)


def _encoder(key: str, shared, pattern: str, cache_bytes: int | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary, until another operator starts there."""
    return kept_state(key, lambda: Encoder(shared.value, pattern, cache_bytes))


def _share(df: DataFrame, path: str, pattern: str):
    ranks = read_ranks(path)
    if sum(map(len, ranks)) > VOCAB_BYTES:
        raise ValueError(f"the vocabulary exceeds {VOCAB_BYTES} bytes")
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return key, df.sparkSession.sparkContext.broadcast(ranks)


def _cut(encoder: Encoder, texts: list[str]) -> list[list[str]]:
    """The pieces of each text, all of them in the encoder's cache."""
    cut = [encoder.pieces_of(t) for t in texts]
    encoder.learn(p for row in cut for p in row)
    return cut


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text (a column of that name is replaced)."""
    df = df.drop(name)
    key, shared = _share(df, path, pattern)

    def run(batches):
        for block in blocks(batches, text_col, BLOCK):
            encoder = _encoder(key, shared, pattern)
            cut = _cut(encoder, texts_of(block, text_col))
            ids = [np.fromstring(" ".join(encoder.cache[p][1] for p in row), np.int32, sep=" ") for row in cut]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*block.schema.names, name])

    return map_arrow(df, run, f"{fields(df)}, `{name}` array<int>", state=key)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each list of ids stands for (a column of that name is replaced)."""
    df = df.drop(name)
    key, shared = _share(df, path, pattern)

    def run(batches):
        for batch in batches:
            encoder = _encoder(key, shared, pattern)
            ids = batch.column(ids_col).to_pylist()
            raw = iter(encoder.decode_rows([x for x in ids if x is not None]))
            out = [None if x is None else next(raw) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    return map_arrow(df, run, f"{fields(df)}, `{name}` binary", state=key)


def token_digests(df: DataFrame, path: str, pattern: str, text_col: str = "text", cache_bytes: int | None = None) -> DataFrame:
    """``df`` without its text, with the number of tokens, a digest of the ids and one of the bytes
    decoded from them. A document's bytes are those of its pieces' tokens in order, so each
    distinct piece is decoded once. Columns of those names are replaced. ``cache_bytes`` bounds what a
    worker remembers (CACHE_BYTES by default): less memory, more pieces encoded again."""
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256")
    key, shared = _share(df, path, pattern)
    key = f"{key}-{cache_bytes}"
    rest = df.drop(text_col)
    keep = rest.columns
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        for block in blocks(batches, text_col, BLOCK):
            encoder = _encoder(key, shared, pattern, cache_bytes)
            n, ids, decoded = [], [], []
            for row in _cut(encoder, texts_of(block, text_col)):
                got = [encoder.cache[p] for p in row]
                n.append(sum(g[0] for g in got))
                ids.append(hashlib.sha256(" ".join([g[1] for g in got]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
            kept = [block.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=names)

    head = f"{fields(rest)}, " if keep else ""
    return map_arrow(df, run, f"{head}n_tokens long, ids_sha256 string, decoded_sha256 string", state=key)
