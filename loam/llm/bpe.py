"""Byte-level BPE encoding and decoding by a pair occurrence index.

The vocabulary and merge ranks come from a public tokenizer file (a path
parameter; nothing is trained or copied). Inside a task the distinct
pre-tokens of an Arrow slice are laid out in one symbol array; an index maps
every mergeable pair to all its positions there, and the active ranks are
applied in ascending order, each merge updating only the lists of the pairs it
touches. Pre-tokens already seen by the task are kept in a bounded cache, so a
common word is merged once per task.

Defined cases: null text encodes like the empty text (no tokens, empty
decoded text); a special token's string in a text becomes its id, as the
public tokenizers library does; repeated rows give equal results; extra
columns of the input pass through untouched.
"""

from __future__ import annotations

import gc
import heapq
import json
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import give_back, sha256_hex, slices

#: Split pattern of the byte-level pre-tokenizer (fixed by the tokenizer format).
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct pre-tokens a task remembers before it forgets them all.
CACHE_WORDS = 400_000
#: Text whose pre-tokens are merged together; a pair index pays off over many.
SLICE_BYTES = 8 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> list[str]:
    """Printable stand-in character of each byte: printable Latin-1 bytes stand
    for themselves, the others take the code points from 256 on, in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class PairIndexBPE:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_re = (
            regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
            if self.specials
            else None
        )
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for tok, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in tok)
        for tok, i in self.specials.items():
            self.token_bytes[i] = tok.encode()
        self.id_text = [str(i) for i in range(size)]
        self.base = size
        self.byte_id = np.array([vocab.get(c, -1) for c in chars], dtype=np.int64)
        # rank -> (left, right, merged); sorted pair keys -> their lowest ranks
        self.rule: list[tuple[int, int, int]] = []
        rank: dict[int, int] = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            ia, ib = vocab[a], vocab[b]
            rank.setdefault(ia * size + ib, len(self.rule))
            self.rule.append((ia, ib, vocab[a + b]))
        keys = np.array([*rank, 2**62], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*rank.values(), -1], dtype=np.int64)[order]
        self.split = regex.compile(SPLIT)
        self.cache: dict = {}
        self._forget()

    def _forget(self) -> None:
        self.cache.clear()
        for i in self.specials.values():
            self._remember(i, [i])

    def _remember(self, word, ids: list[int]) -> None:
        """Ids, ids as text and decoded bytes of a pre-token."""
        self.cache[word] = tuple(ids), ",".join([self.id_text[i] for i in ids]), b"".join([self.token_bytes[i] for i in ids])

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by one pair occurrence index over them all:
        ``where`` maps each active rank to all positions of its pair."""
        base, keys, ranks = self.base, self.pair_keys, self.pair_ranks
        raw = [w.encode("utf-8", "replace") for w in words]
        lens = np.array([len(r) for r in raw], dtype=np.int64)
        n = int(lens.sum()) + len(raw)
        sym = np.full(n, -1, dtype=np.int64)  # -1: the wall behind a word, -2: merged away
        inside = np.ones(n, dtype=bool)
        inside[np.cumsum(lens + 1) - 1] = False
        sym[inside] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(left: np.ndarray, right: np.ndarray, spots: np.ndarray) -> None:
            on = (left >= 0) & (right >= 0)
            pair, spots = left[on] * base + right[on], spots[on]
            at = np.searchsorted(keys, pair)
            known = keys[at] == pair
            r, spots = ranks[at[known]], spots[known]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            r, spots = r[order], spots[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for q, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(spots, cuts)):
                if q not in where:
                    where[q] = [part]
                    heapq.heappush(active, q)
                else:
                    where[q].append(part)

        if n > 1:
            index(sym[:-1], sym[1:], np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            a, b, new = self.rule[r]
            parts = where.pop(r)
            i = np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))
            i = i[sym[i] == a]
            i = i[sym[nxt[i]] == b]
            if a == b:  # of overlapping pairs the leftmost goes first
                taken, free = -1, []
                for x, y in zip(i.tolist(), nxt[i].tolist()):
                    free.append(x != taken)
                    taken = y if x != taken else -1
                i = i[free] if free else i
            if not len(i):
                continue
            j = nxt[i]
            k = nxt[j]
            sym[i], sym[j] = new, -2
            nxt[i], prv[k] = k, i
            p = prv[i]
            fresh = np.full(len(i), new)
            index(np.concatenate([sym[p], fresh]), np.concatenate([fresh, sym[k]]), np.concatenate([p, i]))
        left = sym[sym != -2]
        ends = np.flatnonzero(left == -1).tolist()
        flat = left.tolist()
        return [flat[s:e] for s, e in zip([0, *[e + 1 for e in ends[:-1]]], ends)]

    def _look_up(self, texts: list[str]):
        """Yields the cached entries of the pre-tokens of each text, in order. A
        text is held as its entries; one string stands for all places of a
        pre-token that is still to be merged."""
        cache, fresh, held = self.cache, {}, []
        for t in texts:
            pieces = self._pieces(t)
            try:
                held.append((True, [cache[w] for w in pieces]))
            except KeyError:
                held.append((False, [cache.get(w) or fresh.setdefault(w, w) for w in pieces]))
        if len(cache) + len(fresh) > CACHE_WORDS:
            self._forget()
        todo = list(fresh)
        for w, ids in zip(todo, self.merge(todo)):
            self._remember(w, ids)
        for full, entries in held:
            yield entries if full else [e if type(e) is tuple else cache[e] for e in entries]

    def encode_batch(self, texts: list[str]):
        """Yields the ids of each text (lists of int), in order."""
        for entries in self._look_up(texts):
            yield [i for e in entries for i in e[0]]

    def round_trip_batch(self, texts: list[str]):
        """Yields (number of ids, ids as text, decoded text) of each text; the
        decoded bytes of a pre-token are put together from its ids once."""
        for entries in self._look_up(texts):
            if entries:
                ids, text, raw = zip(*entries)
                yield sum(map(len, ids)), ",".join(text), b"".join(raw).decode("utf-8", "replace")
            else:
                yield 0, "", ""

    def _pieces(self, text: str) -> list:
        if not text:
            return []
        if self.special_re is None or not self.special_re.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += self.split.findall(text[at:m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self.split.findall(text[at:])

    def decode(self, ids: list[int]) -> str:
        tb = self.token_bytes
        return b"".join([tb[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


@contextmanager
def _task_codec(path: str | None):
    """The worker's codec; what a task has remembered goes with the task, since
    the worker lives on beside the stages that follow."""
    codec = _codec(path or default_path())
    try:
        yield codec
    finally:
        codec._forget()
        give_back()


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``out_col`` array<int>: the token ids of ``text_col``. ``path`` must
    name the tokenizer file on every executor (null: the installed public one)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        with _task_codec(path) as codec:
            for big in batches:
                for b in slices(big, text_col, SLICE_BYTES):
                    texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                    ids = pa.array(list(codec.encode_batch([t or "" for t in texts])), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out_col`` string: the text of the token ids (null: empty)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType(), False)])

    def run(batches):
        codec = _codec(path or default_path())
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            text = pa.array([codec.decode(i or []) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def round_trip_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes every text in one pass; returns ``id_col``,
    n_tokens, ids_sha256, decoded_sha256 without moving the ids to the JVM."""
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ])

    def run(batches):
        gc.disable()  # no cycles are made here; scanning the cache again and again costs a quarter of the time
        try:
            with _task_codec(path) as codec:
                yield from digests(codec, batches)
        finally:
            gc.enable()

    def digests(codec, batches):
        for big in batches:
            for b in slices(big, text_col, SLICE_BYTES):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                n, hi, hd = [], [], []
                for size, ids, text in codec.round_trip_batch([t or "" for t in texts]):
                    n.append(size)
                    hi.append(sha256_hex(ids.encode()))
                    hd.append(sha256_hex(text.encode()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(id_col)), pa.array(n, pa.int64()), pa.array(hi, pa.string()), pa.array(hd, pa.string())],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
