"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes there is one token that ends the prefix's encoding. It is the one
token that is a suffix of the prefix and fits the last token of the prefix before it, where two tokens
fit if encoding their joined bytes gives just the two. Storing that token per prefix encodes a piece in
time linear in its length, lets bytes be appended without looking back further than the longest
token, and makes an edit recompute only until the stored tokens agree again.

Texts are first split by the vocabulary's pattern, each match being encoded on its own; a match that is
itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, worker_cache

#: Pieces that one Python worker remembers, twice: when full, the younger half becomes the older, which
#: is searched before a piece is encoded again. Results do not depend on it.
REMEMBERED = 220_000
#: Longer pieces are encoded but not remembered.
REMEMBERED_BYTES = 48
#: Unicode white space, which ``\s`` of the splitting pattern stands for.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


BEYOND = re.compile("[\U00010000-\U0010ffff]")


def category_class(letter: str, below: int) -> str:
    """Ranges of the code points under ``below`` whose Unicode category begins with ``letter``."""
    inside = [unicodedata.category(chr(i))[0] == letter for i in range(below)] + [False]
    edges = [i for i in range(len(inside)) if inside[i] != (i > 0 and inside[i - 1])]
    return "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def splitter(pattern: str, below: int = sys.maxunicode + 1) -> re.Pattern:
    """The pattern with its classes spelled out as ranges, for texts of code points under ``below``."""
    spelled = pattern
    for old, new in ((r"\p{L}", category_class("L", below)), (r"\p{N}", category_class("N", below))):
        spelled = re.sub(r"(\[[^\]]*)" + re.escape(old), lambda m, new=new: m[1] + new, spelled).replace(old, f"[{new}]")
    spelled = spelled.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return re.compile(spelled)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@dataclass
class Prefixes:
    """A piece with the last token of each of its prefixes."""

    data: bytes
    last: list[int] = field(default_factory=list)


class Vocabulary:
    """Tokens of a rank table and the prefix encoder over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # the shorter a class, the faster it is matched; most texts need the first only
        self.latin, self.plane, self.all = (splitter(pattern, n) for n in (0x100, 0x10000, sys.maxunicode + 1))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits_known: dict[tuple[int, int], bool] = {}
        self.valid: set[int] = set()
        for data, token in sorted(ranks.items(), key=lambda x: x[1]):
            if len(data) == 1:
                self.parts[token] = (token, token)
                self.valid.add(token)
                continue
            halves = self._merged(data, token)
            if len(halves) == 2:
                self.parts[token] = halves
                self.joined[halves] = token
                self.valid.add(token)
        self.finder = ahocorasick.Automaton()
        for token in self.valid:
            data = self.bytes_of[token]
            self.finder.add_word(data.decode("latin-1"), (token, len(data)))
        self.finder.make_automaton()
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def _merged(self, data: bytes, below: int) -> tuple[int, ...]:
        """Tokens of ``data`` after all merges of rank less than ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def fits(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens encode to just these two.

        Undo the later merge of the two sides step by step; if at any stage the touching tokens would
        have merged before that merge was made, the pair cannot stand.
        """
        known = self.fits_known.get((left, right))
        if known is not None:
            return known
        a, b, limit, out = left, right, 1 << 62, True
        while True:
            merged = self.joined.get((a, b))
            if merged is not None and merged < limit:
                out = False
                break
            if a > b:
                limit, inner = a, self.parts[a][1]
                if inner == a:
                    limit, inner = b + 1, self.parts[b][0]
                    if inner == b:
                        break
                    b = inner
                else:
                    a = inner
            else:
                limit, inner = b + 1, self.parts[b][0]
                if inner == b:
                    limit, inner = a, self.parts[a][1]
                    if inner == a:
                        break
                    a = inner
                else:
                    b = inner
        if len(self.fits_known) < 2_000_000:
            self.fits_known[(left, right)] = out
        return out

    def extend(self, state: Prefixes, more: bytes) -> Prefixes:
        """Append bytes: only tokens that end in the new bytes are looked at."""
        start = len(state.data)
        state.data += more
        last = state.last
        last.extend([-1] * len(more))
        tail = max(0, start - self.longest)
        for end, (token, size) in self.finder.iter(state.data[tail:].decode("latin-1")):
            end += tail
            if end < start or last[end] >= 0:
                continue
            before = end - size
            if before < 0 or self.fits(last[before], token):
                last[end] = token
        return state

    def edit(self, state: Prefixes, start: int, end: int, new: bytes) -> Prefixes:
        """Replace bytes ``start`` to ``end``: prefixes before stay, those after are recomputed until they agree.

        A prefix's token depends on the ``longest`` prefixes before it, so once that many agree in a
        row (past the edit) all further ones do.
        """
        old, tail = state.last, state.data[end:]
        out = self.extend(Prefixes(state.data[:start], old[:start]), new)
        at = 0
        while at < len(tail):
            step = tail[at : at + 2 * self.longest]
            self.extend(out, step)
            at += len(step)
            if at >= self.longest and out.last[-self.longest :] == old[end + at - self.longest : end + at]:
                out.data += tail[at:]
                out.last += old[end + at :]
                break
        return out

    def tokens(self, state: Prefixes) -> list[int]:
        """The encoding, read backwards from the last prefix."""
        out, at = [], len(state.data)
        while at:
            token = state.last[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def piece(self, text: str) -> tuple[tuple[int, ...], str, bytes]:
        """Tokens of one match of the pattern, their decimal form, and the bytes they decode to."""
        got = self.older.get(text)
        if got is None:
            data = text.encode()
            whole = self.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.tokens(self.extend(Prefixes(b""), data)))
            got = (ids, ",".join(map(str, ids)), self.decode(ids))
            if len(data) > REMEMBERED_BYTES:
                return got
        if len(self.known) >= REMEMBERED:
            self.older = dict(self.known)
            self.known.clear()
        self.known[text] = got
        return got

    def split(self, text: str) -> list[str]:
        """Matches of the pattern, which together are the text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.all if BEYOND.search(text) else self.plane).findall(text)
        return self.latin.findall(text)

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        known, piece = self.known.get, self.piece
        return [known(p) or piece(p) for p in self.split(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([x[0] for x in self.pieces(text)]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _vocabulary(rank_lines: bytes, pattern: str) -> Vocabulary:
    """One vocabulary a worker process."""
    ranks = lambda: {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
    return worker_cache("bpe", (hash(rank_lines), pattern), lambda: Vocabulary(ranks(), pattern))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Ids of every whole text, and the round trip.

    ``vocabulary`` is the path of a rank file; it is read on the driver and travels with the tasks (its
    size is that of the vocabulary). Returns key, ids (unless ``with_ids`` is false), n_tokens,
    ids_sha256 and decoded_sha256. Null text counts as empty and has no ids; other columns are
    ignored; repeated rows get equal rows.
    """
    with open(vocabulary, "rb") as file:
        lines = file.read()
    spread = docs.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(spread.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_hash, bytes_hash, all_ids = [], [], [], []
                for value in part.column(1):
                    found = v.pieces(value.as_py() or "")
                    n.append(sum([len(x[0]) for x in found]))
                    ids_hash.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                    bytes_hash.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
                    if with_ids:
                        all_ids.append(list(chain.from_iterable([x[0] for x in found])))
                cols = [part.column(0), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(bytes_hash)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {'ids array<int>, ' if with_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the multilingual byte-level vocabulary."""
    import public_tokenizers as public

    return encode_documents(read_table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, with_ids=False)
