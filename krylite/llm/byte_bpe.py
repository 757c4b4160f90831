"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a vocabulary file become a tokenizers model: bytes are mapped to printable characters, merges are
recovered from the ranks, and texts are split by the given pattern. The library returns character offsets; `encode`
can turn them into byte offsets. Decoding maps characters back to bytes, so that characters split over several tokens
come back whole.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain
from struct import pack

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, slices


#: Fixed value: the splitting rule for which the compiled splitter stands in; other patterns go through a regex engine.
COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shown_bytes() -> list[str]:
    """The printable character for each byte, as byte-level BPE files write them."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair whose merge makes the token: what is left when only merges of lower rank are done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = rank, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], rank)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = shown_bytes()
        show = lambda t: "".join(chars[b] for b in t)
        pairs = sorted((r, m) for t, r in ranks.items() if len(t) > 1 and (m := merge_of(t, r, ranks)))
        model = models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for _, (a, b) in pairs])
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.of_piece = Tokenizer(model)
        self.of_piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if pattern == COMMON_PATTERN:
            from .token_counts import Splitter

            self.splitter = Splitter()
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {r: bytes(back[c] for c in show(t)) for t, r in ranks.items()}
        self.token_list = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers. The library encodes each different piece of a batch once; what it
        gave is kept for later batches."""
        out, known = [], self.known
        for a, b in slices(texts, 1_000_000):
            pieces = self.pieces(texts[a:b])
            if len(known) > 500_000:
                known.clear()
            new = [p for p in set(chain.from_iterable(pieces)) if p not in known]
            for p, e in zip(new, self.of_piece.encode_batch_fast(new, add_special_tokens=False), strict=True):
                ids = e.ids
                known[p] = pack(f"<{len(ids)}I", *ids)
            out += [b"".join(map(known.__getitem__, x)) for x in pieces]
        return out

    def pieces(self, texts: list[str]) -> list[list[str]]:
        if not hasattr(self, "splitter"):
            return [self.split(t) for t in texts]
        joined, _, begin, end, owner = self.splitter.cut(texts)
        flat = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and (start, end) code points of each token; tokens that share a character share its place."""
        return [(e.ids, e.offsets) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_list.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(ranks_path: str, pattern: str) -> ByteBpe:
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int), starts and ends (arrays of int, code points) for each row; null texts give empty arrays."""

    def work(texts: list[str]) -> list[list]:
        got = loaded(ranks_path, pattern).encode_with_offsets(texts)
        return [[x for x, _ in got], [[a for a, _ in o] for _, o in got], [[b for _, b in o] for _, o in got]]

    return map_texts(df, [key], text, "ids array<int>, starts array<int>, ends array<int>", work)


def decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the decoded bytes (binary) of each row's ids; null ids give no bytes."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType, StructField, StructType

    narrow = df.select(key, F.col(ids).alias("__ids"))
    schema = StructType([narrow.schema[key], StructField("decoded", BinaryType())])

    def run(batches):
        import pyarrow as pa

        book = loaded(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([book.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], [key, "decoded"])

    return narrow.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids, and give digests: key, n_tokens, ids_sha256, decoded_sha256.

    The ids are hashed as little-endian unsigned 32-bit integers. A null text counts as empty (no ids, digests of
    nothing); texts are encoded whole; an empty table gives no rows; other columns are ignored.
    """

    def work(texts: list[str]) -> list[list]:
        book = loaded(ranks_path, pattern)
        n, a, b = [], [], []
        for packed in book.encode_packed(texts):
            n.append(len(packed) // 4)
            a.append(hashlib.sha256(packed).hexdigest())
            b.append(hashlib.sha256(book.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
        return [n, a, b]

    return map_texts(df, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), PATTERN)
