import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from krylite.llm import byte_bpe, token_counts  # noqa: E402

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TRICKY = ["", " ", "\n", "it's  'S we'rea 'r 'v 'l 'lx ''s !'s  'd\n\nfoo \n bar \t\t x", "a<|endoftext|> b<|endoftext|>", "日本語 ½²٣", "a" * 5000, "' ", "x'", " 'll", "é'ré", "\x00a b\x85c\x1cd", "'re've'll'm'ss", "🙂🙂 🙂", "no break"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_tricky_texts(library):
    got = token_counts.compiled(JSON).count(TRICKY)
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in TRICKY]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'rvelsmdtLA1.é!"), st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF)), max_size=40), min_size=1, max_size=6))
def test_counts_of_random_texts(texts):
    from tokenizers import Tokenizer

    lib = test_counts_of_random_texts.__dict__.setdefault("lib", Tokenizer.from_file(JSON))
    assert token_counts.compiled(JSON).count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_compose_alike(library):
    c = token_counts.compiled(JSON)
    classes = c.splitter.classes[np.frombuffer(("it's a 'test'  of\n\n chunks we'll cut " * 40).encode("utf-32-le"), np.uint32)]
    want = token_counts.piece_starts(classes, c.splitter.step, c.splitter.emit, chunk=len(classes))
    for chunk in (1, 2, 7, 64):
        assert (token_counts.piece_starts(classes, c.splitter.step, c.splitter.emit, chunk) == want).all()


def test_states_are_compiled_again_after_reset():
    c = token_counts.CompiledTokenizer(JSON)
    want = c.count(TRICKY)
    c.pieces.reset()
    assert c.count(TRICKY) == want


def test_long_pieces_and_few_states(library):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = ["".join(letters[rng.integers(0, 26, 30_000)]), "a" * 20_001, "ab" * 9_000 + " x " + "é" * 9_000, "-" * 12_345, "".join(letters[rng.integers(0, 3, 9_000)]) + "1" * 7_000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    c = token_counts.CompiledTokenizer(JSON)
    assert c.count(texts) == want
    whole = c.pieces.counts
    c.pieces.counts = lambda data, start, length: whole(data, start, length, 200)
    assert c.count(texts) == want and len(c.pieces.states) < 3000


def test_chunk_maps_compose():
    f, g = {"s": ("a", 2), "t": ("b", 3)}, {"a": ("z", 5)}
    assert token_counts.composed(f, g) == {"s": ("z", 7)} and token_counts.composed(f) is f


def test_token_count_rows(spark):
    rows = [(1, "hello world", 9), (1, "hello world", 9), (None, None, 1), (3, "", 2), (4, "x " * 20000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.token_counts(df, JSON).collect()}
    assert got[(1, 11)].n_tokens == 2 and not got[(1, 11)].over_limit
    assert got[(None, 0)].n_tokens == 0 and got[(3, 0)].n_tokens == 0
    assert got[(4, 40000)].over_limit
    assert token_counts.token_counts(df, JSON).count() == 5
    assert token_counts.token_counts(df.limit(0), JSON).count() == 0


def test_bpe_equals_reference(reference):
    book = byte_bpe.loaded(RANKS, P.PATTERN)
    ids = book.encode(TRICKY)
    assert ids == [reference.encode_ordinary(t) for t in TRICKY]
    assert [book.decode(x) for x in ids] == [t.encode() for t in TRICKY]
    assert [x for x, _ in book.encode_with_offsets(TRICKY)] == ids


def test_other_pattern(reference):
    import tiktoken

    other = tiktoken.Encoding("o", pat_str=r"\w+|\W", mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    assert byte_bpe.loaded(RANKS, r"\w+|\W").encode(TRICKY) == [other.encode_ordinary(t) for t in TRICKY]


def test_offsets_of_split_characters():
    ids, offsets = byte_bpe.loaded(RANKS, P.PATTERN).encode_with_offsets(["a🙂b"])[0]
    assert len(ids) == len(offsets) and {o for o in offsets} >= {(0, 1), (1, 2), (2, 3)}


def test_round_trip_rows(spark):
    df = spark.createDataFrame([(1, "añb🙂", "k"), (1, "añb🙂", "k"), (2, None, None), (3, "", "")], "doc_id long, text string, ids_sha256 string")
    got = byte_bpe.round_trip(df, RANKS, P.PATTERN).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and got[0] == got[1]
    assert got[0].decoded_sha256 == hashlib.sha256("añb🙂".encode()).hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got[2:])
    coded = byte_bpe.encode(df, RANKS, P.PATTERN)
    back = byte_bpe.decode(coded, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted(x.encode() for x in ("añb🙂", "añb🙂", "", ""))
    assert byte_bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
