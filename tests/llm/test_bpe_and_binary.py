import hashlib
import random
import zlib
from itertools import chain

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from terrarank.llm import binary, bpe

RANKS, WORDS = public.path("byte_bpe_multi_50k.tiktoken"), public.path("word_bpe_49k.json")
TEXTS = ["", " ", "  ", "a ", " a", "a  b", "a\n\nb", "a \n b ", "\n a", "x" * 5000, " " * 3000, "ab" * 4000, "日本語" * 500, "возможности" * 50,
         "don't we'll  \n", "́ ́", "<|endoftext|> x", "a\x1c b\x85 c", None, "😀" * 40]


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(RANKS, public.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_encoding_agrees_with_the_library(own, library):
    random.seed(4)
    letters = "ab  \n\t\r 　'sthe,.!?0123éßжя日本語😀\x1c\x85<|endoftext|>ÀAZz"
    texts = [t or "" for t in TEXTS] + ["".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == library.encode_ordinary(t)
        assert "".join(own.decode(ids)) == t


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(own, library, text):
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_few_states_give_the_same_tokens(own, library):
    small = bpe.Transducer(bpe.load_ranks(RANKS), 20)
    for t in TEXTS[:15]:
        assert list(chain.from_iterable(small.piece(p.encode()) for p in own.match(t))) == library.encode_ordinary(t)


def test_tokens_come_out_before_the_piece_ends(own):
    read = 0

    def endless():
        nonlocal read
        for b in b"internationalisation" * 100:
            read += 1
            yield b
    assert next(own.machine.stream(endless())) >= 0 and read < 80


def test_decoding_streams_over_block_ends(own):
    ids = own.encode("日本😀" * 5000)
    assert len(ids) > bpe.DECODED_AT_ONCE and "".join(own.decode(ids)) == "日本😀" * 5000
    assert "".join(own.decode(np.array([own.machine.ranks[b"\xe3"]], np.uint32))) == "�"


def test_round_trip_query(spark, documents, library):
    docs = documents([(i, t, "a") for i, t in enumerate(TEXTS)] + [(None, "x", None), (3, "a ", "a")])
    rows = bpe.round_trip(docs, RANKS, public.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    tokens = bpe.encode(docs, RANKS, public.PATTERN, ("doc_id", "source"))
    back = {r.doc_id: r.text for r in bpe.decode(tokens, RANKS, public.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.round_trip(docs.limit(0), RANKS, public.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(numbers=st.lists(st.integers(-2**62, 2**62) | st.integers(0, 50), max_size=600))
def test_elias_fano(numbers):
    numbers = np.sort(np.array(numbers, np.int64))
    list_, rest = binary.EliasFano.unpack(memoryview(binary.EliasFano.of(numbers).pack() + b"rest"))
    assert bytes(rest) == b"rest" and (list_.all() == numbers).all()
    assert all(list_.select(k) == numbers[k] for k in range(0, len(numbers), 7))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1000, 20_000))
    assert len(binary.EliasFano.of(ends).pack()) * 8 < 20_000 * (2 + np.log2(500) + 1.5)


def test_words_give_the_library_s_ids():
    library = Library.from_file(WORDS)
    random.seed(2)
    texts = ["", "  a  b ", "ΑΣ ΣΑΣ", "don't WE'LL\n\tx", "é é ́a", "<|endoftext|> x", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "<|endof\ntext|>", "İstanbul ß"]
    texts += ["".join(random.choice("aB Σ'\ńéß12.,日 ") for _ in range(random.randint(0, 40))) for _ in range(2000)]
    assert [x.tolist() for x in binary.Tokenizer(WORDS).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_known_from_other_words_are_not_encoded_again():
    """Words put together from known letters, marks and digits cost the library nothing, wherever the marks stand."""
    class Spy:
        texts = 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return library.encode_batch_fast(texts, **options)

    library, spy = Library.from_file(WORDS), Spy()
    own = binary.Tokenizer(WORDS)
    own.library = spy
    own.encode(["word été ( ) . , 1 2"])
    assert spy.texts > 0
    spy.texts = 0
    texts = ["(WORD) Été,1word.2", "", " \n", "21été(", "word word(word"]
    got = own.encode(texts)
    assert spy.texts == 0
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_each_letter_and_mark_between_others():
    """Every character of ASCII and Latin-1, and some after them, before, in and after words, alone and in one batch."""
    library, own = Library.from_file(WORDS), binary.Tokenizer(WORDS)
    texts = [t for c in map(chr, [*range(0x180), 0x301, 0x3a3, 0x2019, 0x65e5, 0x1f600]) for t in (c, f"{c}aB", f"a{c}B", f"É1{c} x", f"x {c}{c}", f"({c})\n{c}é")]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [own.encode([t])[0].tolist() for t in texts] == want


def test_another_tokenizer_gets_whole_texts(tmp_path):
    """A file whose patterns aren't known to keep words apart is not cut at spaces."""
    import json

    with open(WORDS, encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+( \p{L}+)*"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    texts = ["two words", "", "a b 1 c\nd"]
    own = binary.Tokenizer(str(path))
    assert not own.apart
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in Library.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]


def test_files_read_back(spark, documents, tmp_path):
    rows = [(i * 7 % 101, f"Some words {i} " * (i % 5), "a") for i in range(101)] + [(500, None, None), (None, "null id", "b"), (None, None, "b"), (3, "again", "b"), (-4, "x" * 100_000, "b")]
    docs = documents(rows)
    binary.write(docs, f"{tmp_path}/t", WORDS, end_id=2, segment_ids=200)
    library = Library.from_file(WORDS)
    got = binary.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(got) == len(rows) and [g.doc_id for g in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    for g in got:
        assert g.start == start and g.n_tokens == len(g.ids) and g.ids in want[g.doc_id]
        want[g.doc_id].remove(g.ids)
        start += g.n_tokens
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in binary.checksums(spark, f"{tmp_path}/t").collect()}
    assert all(crc[g.doc_id, g.start] == zlib.crc32(np.array(g.ids, "<u4").tobytes()) for g in got)
    data = spark.read.parquet(f"{tmp_path}/t/segments").orderBy("part", "number").first().data
    segment = binary.Segment(bytes(data))
    ends = segment.ends.all().tolist()
    assert all(segment.document(k).tolist() == segment.ids[a:b].tolist() for k, (a, b) in enumerate(zip([0, *ends], ends)))
    binary.write(docs.limit(0), f"{tmp_path}/none", WORDS)
    assert binary.read(spark, f"{tmp_path}/none").count() == 0
