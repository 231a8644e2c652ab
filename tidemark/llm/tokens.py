"""Encoding of texts with a public byte-level BPE vocabulary, in time linear in the text.

A text is cut into pieces by the vocabulary's pattern; a piece's bytes, mapped to
Latin-1, run through an Aho-Corasick automaton of all tokens, which gives the longest
token at each place. From these the encoder goes left to right and backtracks where
two neighbours could not stand beside each other: a sequence of tokens is what the
merges give exactly if each adjacent pair is what they give for the pair alone.
Pairs and short pieces are memoised per worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text into pieces, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# First and last of the letters and numbers that Unicode has only since version 17. The published tokenizers
# cut by Unicode 16, to which these are signs like any other that is not assigned.
LATER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d
107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686
16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f""".split()
LATER_SIGN = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (r.split("-") for r in LATER)) + "]")
UNASSIGNED = "\u0378"
PIECES_KEPT = 300_000
PIECE_KEPT_LENGTH = 64


class Encoder:
    """Token ids of a text by ranked byte merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.kept: dict[str, list[int]] = {}
        self.own: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def split(self, text: str) -> list[str]:
        """The pieces of a text, as Unicode 16 tells letters and numbers from signs."""
        if text.isascii() or not LATER_SIGN.search(text):
            return self.find(text)
        out, at = [], 0
        for piece in self.find(LATER_SIGN.sub(UNASSIGNED, text)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def merged(self, raw: bytes) -> list[int]:
        """The merges carried out step by step: for single tokens and pairs of tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether merges ever give this token."""
        if token not in self.own:
            self.own[token] = self.merged(self.bytes_of[token]) == [token]
        return self.own[token]

    def fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        if pair not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[pair] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.pairs[pair]

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 where there is none."""
        if token not in self.shorter:
            raw = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), -1)
        return self.shorter[token]

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None and self.reachable(whole):
            return [whole]
        n = len(raw)
        longest = [(0, -1)] * n
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            start = end - length + 1
            if length > longest[start][0]:
                longest[start] = (length, token)
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0][1]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.bytes_of[token])
                if not dead[end] and (self.fits(last, token) if last >= 0 else self.reachable(token)):
                    break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                dead[at] = 1
                out.pop()
                at -= len(self.bytes_of[last])
                token = self.prefix(last)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for p in self.split(text):
            ids = kept.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= PIECE_KEPT_LENGTH:
                    if len(kept) >= PIECES_KEPT:
                        kept.clear()
                    kept[p] = ids
            out += ids
        return out


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    ranks = {}
    for line in blob.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


@lru_cache(maxsize=2)
def _encoder(digest: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(_blobs[digest]), pattern)


_blobs: dict[str, bytes] = {}


def _ids(batches: Iterator[pa.RecordBatch], vocabulary, digest: str, pattern: str, count: bool) -> Iterator[pa.RecordBatch]:
    if digest not in _blobs:
        _blobs[digest] = vocabulary.value
    encode = _encoder(digest, pattern).encode
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        ids = [encode(t.as_py()) for t in texts]
        last = pa.array([len(x) for x in ids], pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], "_out"])


def _encoded(docs: DataFrame, keep: list[str], text: str, name: str, count: bool, path: str, pattern: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as file:
        blob = file.read()
    digest = hashlib.sha256(blob).hexdigest()
    shared = spark.sparkContext.broadcast(blob)  # a vocabulary file: a few MB at any size of corpus
    kind = "bigint" if count else "array<int>"
    columns = docs.select(*keep, F.col(text).alias("_text"))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1]]
    return columns.mapInArrow(lambda it: _ids(it, shared, digest, pattern, count), ", ".join([*names, f"_out {kind}"])).withColumnRenamed("_out", name)


def token_ids(docs: DataFrame, keep: list[str], text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}", pattern: str = PATTERN) -> DataFrame:
    """The columns in keep and ``ids`` (array of int), without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts have
    the empty list; texts of any length are encoded whole; repeated rows give repeated
    rows. No shuffle: rows stay where they are read.
    """
    return _encoded(docs, keep, text, "ids", False, path, pattern)


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}", pattern: str = PATTERN) -> DataFrame:
    """The columns in keep and ``n_tokens``, the length of token_ids' list."""
    return _encoded(docs, keep, text, "n_tokens", True, path, pattern)
