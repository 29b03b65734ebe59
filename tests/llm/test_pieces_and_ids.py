import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import DOCS, by_id, documents
from tokenizers import Tokenizer

from plumbline.llm import bytestream, pieces, repair

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(MODEL)


# --- pieces ----------------------------------------------------------------------------


def flat_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def paths(text, known, alpha):
    """Every segmentation of a short text with its probability."""
    found = {(): 1.0}

    def go(at, ids, weight):
        if at == len(text):
            found[ids] = found.get(ids, 0) + weight
            return
        hit = False
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in known:
                piece, w = known[text[at:end]]
                go(end, (*ids, piece), weight * np.exp(alpha * w))
                hit = hit or end == at + 1
        if not hit:
            own = known_bytes(known, text[at])
            go(at + 1, (*ids, *own[0]), weight * np.exp(alpha * own[1]))

    def known_bytes(known, char):
        raw = char.encode()
        return tuple(known["bytes"][b] for b in raw), known["least"] * len(raw)

    found.clear()
    go(0, (), 1.0)
    total = sum(found.values())
    return {ids: p / total for ids, p in found.items()}


def test_draws_follow_the_lattice(vocabulary):
    """Shares of sampled segmentations are those of all paths, worked out one by one."""
    text, alpha = " thinst🙂", 0.3
    known = {r.decode(): (i, vocabulary.weight[i]) for i, r in enumerate(vocabulary.raw) if r and i not in set(vocabulary.byte_piece.tolist()) and _utf8(r)}
    known |= {"bytes": vocabulary.byte_piece.tolist(), "least": vocabulary.weight[vocabulary.byte_piece].min()}
    expected = paths(text, known, alpha)
    data, offsets = flat_of([text] * 20_000)
    ids, begin = pieces.Lattices(vocabulary, alpha).sample(data, offsets, np.arange(20_000, dtype=np.uint64), 1)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:]))
    assert set(got) <= set(expected)
    for path, p in expected.items():
        assert abs(got[path] / 20_000 - p) < 4 * np.sqrt(p * (1 - p) / 20_000) + 1e-4


def _utf8(raw):
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=6))
def test_decoding_is_lossless(texts):
    voc = _shared()
    data, offsets = flat_of(texts)
    ids, begin = pieces.Lattices(voc, 1.0).sample(data, offsets, np.arange(len(texts), dtype=np.uint64), 5)
    assert [pieces.decode(ids[a:b], voc).decode() for a, b in zip(begin[:-1], begin[1:])] == texts


_VOC = []


def _shared():
    if not _VOC:
        _VOC.append(pieces.load(MODEL))
    return _VOC[0]


def test_draws_do_not_depend_on_neighbours_or_cache(vocabulary):
    texts = [t or "" for _, t, *_ in DOCS]
    keys = np.arange(len(texts), dtype=np.uint64)
    data, offsets = flat_of(texts)
    ids, begin = pieces.Lattices(vocabulary, 1.0).sample(data, offsets, keys, 7)
    lattices = pieces.Lattices(vocabulary, 1.0)
    for i, text in reversed(list(enumerate(texts))):
        data, offsets = flat_of([text])
        own, _ = lattices.sample(data, offsets, keys[i : i + 1], 7)
        assert (own == ids[begin[i] : begin[i + 1]]).all()
        lattices.clear()


def test_encoded_rows(spark):
    docs = documents(spark)
    told, (ids, n, lossless) = pieces.encoded(docs, MODEL)
    assert told.columns == [*docs.columns, ids, n, lossless]
    back = pieces.decoded(told, MODEL, ids, "back")
    rows = by_id(back)
    assert len(rows) == len(DOCS)
    for r in rows:
        assert r["back"] == (r["text"] or "") and r[lossless] and r[n] == len(r[ids])
    assert by_id(pieces.encoded(docs.repartition(7), MODEL)[0]) == by_id(told)
    assert pieces.encoded(docs.limit(0), MODEL)[0].count() == 0


# --- packed ids --------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=8), st.integers(1, 6))
def test_packing_is_a_round_trip(docs, least):
    ids = [np.array([*d, 0], np.int32) for d in docs]
    flat_ids = np.concatenate(ids)
    ends = np.zeros(len(flat_ids), bool)
    ends[np.cumsum([len(x) for x in ids]) - 1] = True
    symbols, last, rules = repair.compress(flat_ids, ends, 6, rounds=5, least=least)
    assert (repair.expand(symbols, rules, 6) == flat_ids).all()
    assert last.sum() == len(docs) and (rules < 6 + np.arange(len(rules))[:, None]).all()
    lengths = repair.expansion_lengths(rules, 6)
    assert lengths[symbols].sum() == len(flat_ids)


def test_any_stretch_of_a_shard():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 300, 4).tolist() for _ in range(20)]
    ids = [np.array([x for w in rng.integers(0, 20, rng.integers(0, 60)) for x in words[w]] + [0], np.int32) for _ in range(50)]
    raw = repair.shard_bytes([None, *range(1, 50)], ids, 300)
    shard, whole = repair.Shard(raw), np.concatenate(ids)
    assert len(shard.rules) and len(shard.symbols) < len(whole)
    assert [d for d, *_ in shard.documents()] == [None, *range(1, 50)]
    for _ in range(200):
        a = int(rng.integers(0, len(whole)))
        n = int(rng.integers(1, min(400, len(whole) - a) + 1))
        assert (shard.tokens(a, n) == whole[a : a + n]).all()


@pytest.mark.parametrize("shard_tokens", [50, 3_000_000])
def test_files_read_back(spark, tmp_path, shard_tokens):
    own = Tokenizer.from_file(BPE)
    docs = documents(spark).repartition(4)
    files = repair.write_ids(docs, str(tmp_path / "ids"), BPE, shard_tokens=shard_tokens)
    got = {}
    for r in repair.read_ids(files, str(tmp_path / "ids")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, zlib.crc32(r.ids)))
    start = 0
    for doc, text in sorted(((d, t) for d, t, *_ in DOCS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        assert (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got[doc]
        start += len(ids)
    assert sum(map(len, got.values())) == len(DOCS)


def test_no_documents(spark):
    assert repair.packed_ids(documents(spark).limit(0), BPE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_chunks_encode_as_whole_texts(texts):
    own = Tokenizer.from_file(BPE)
    cache, _ = repair.tokenizer(BPE)
    cache.clear()
    data, offsets = flat_of(texts)
    values, begin = cache.lookup(data, offsets)
    for text, a, b in zip(texts, begin[:-1], begin[1:]):
        assert values[a:b].tolist() == own.encode(text, add_special_tokens=False).ids


def test_query_returns_the_pieces(spark):
    from plumbline.llm import queries

    rows = queries.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.lossless and len(r.piece_ids) == r.n_pieces for r in rows)


def counted_searches(monkeypatch, module):
    """Sizes of the searches that a module makes from now on."""
    sizes, search = [], np.searchsorted

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def searchsorted(self, a, v, *rest):
            sizes.append(np.size(v))
            return search(a, v, *rest)

    monkeypatch.setattr(module, "np", Counting())
    return sizes


def test_most_stretches_are_not_searched_for(vocabulary, monkeypatch):
    """Stretches of a word of no piece are turned away by a table; of 16 lengths few are left."""
    rng = np.random.default_rng(4)
    words = [" " + "".join(chr(c) for c in rng.integers(97, 123, 12)) for _ in range(500)]
    lattices = pieces.Lattices(vocabulary, 1.0)
    sizes = counted_searches(monkeypatch, pieces)
    lattices.add([w.encode() for w in words])
    stretches = sum(len(w) - length + 1 for w in words for length in vocabulary.by_length if length <= len(w))
    known = {r.decode() for i, r in enumerate(vocabulary.raw) if r and i not in set(vocabulary.byte_piece.tolist()) and _utf8(r)}
    edges = sum(w[a:b] in known for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1))
    assert (lattices.edge_piece >= 0).sum() == edges
    assert sum(sizes) < stretches / 2


def test_a_chunk_longer_than_16_bits_has_its_lattice(vocabulary):
    text = "ab" * 40_000
    data, offsets = flat_of([text])
    ids, _ = pieces.Lattices(vocabulary, 1.0).sample(data, offsets, np.arange(1, dtype=np.uint64), 1)
    assert pieces.decode(ids, vocabulary).decode() == text


def test_few_pairs_are_searched_for_in_a_round(monkeypatch):
    """Of pairs whose parts are in rules, those of no rule are turned away by a table."""
    rng = np.random.default_rng(6)
    ids = rng.integers(1, 600, 200_000).astype(np.int32)
    # A few frequent pairs, with every symbol as the left and as the right part of one.
    ids = np.concatenate([ids, np.tile(np.stack([np.arange(1, 600), np.roll(np.arange(1, 600), 7)], axis=1).ravel(), 40)]).astype(np.int32)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    sizes = counted_searches(monkeypatch, repair)
    symbols, _, rules = repair.compress(ids, ends, 600, rounds=1, least=30)
    assert 0 < len(rules) < 2_000
    assert sum(sizes) < len(ids) / 2
    assert (repair.expand(symbols, rules, 600) == ids).all()


def test_expanding_by_a_table_gives_the_same_ids():
    rng = np.random.default_rng(7)
    ids = np.tile(rng.integers(1, 90, 2_000), 30).astype(np.int32)
    ends = np.zeros(len(ids), bool)
    ends[999::1000] = True
    symbols, _, rules = repair.compress(ids, ends, 90)
    lengths = repair.expansion_lengths(rules, 90)[90:]
    assert lengths.max() > 8
    assert (repair.expand_by_table(symbols, rules, lengths, 90) == ids).all()
    none = np.zeros((0, 2), np.uint32)
    assert repair.expand_by_table(symbols[:0], none, lengths[:0], 90).tolist() == []


def test_encoded_chunks_stand_in_their_order():
    """Chunks that are words of their own and others take different ways, and come back in order."""
    chunks = [b"one", b" two", "  drei".encode(), b" vier", b" ", b" two\n", b"five", b" sechs"]
    cache, _ = repair.tokenizer(BPE)
    values, sizes = cache.make(chunks)
    own = Tokenizer.from_file(BPE)
    expected = [own.encode(c.decode(), add_special_tokens=False).ids for c in chunks]
    assert sizes.tolist() == [len(e) for e in expected]
    assert values.tolist() == [i for e in expected for i in e]


def test_words_are_encoded_once_whatever_mark_follows():
    texts = ["one two. one two, one two! one two", ". two?", "a.<|endoftext|>.b a<|endoftext|>", "x'll.y's;z. é.é", "two.\n\nTwo. .,two  ,"]
    cache, _ = repair.tokenizer(BPE)
    cache.clear()
    data, offsets = flat_of(texts)
    values, begin = cache.lookup(data, offsets)
    own = Tokenizer.from_file(BPE)
    for text, a, b in zip(texts, begin[:-1], begin[1:]):
        assert values[a:b].tolist() == own.encode(text, add_special_tokens=False).ids
    cache.clear()
    cache.lookup(*flat_of(texts[:1]))
    assert cache.entries == len(["one", " two", ".", " one", ",", "!"])


def test_vocabularies_with_other_words_have_no_marks(tmp_path):
    """A begin that gets a blank differs from the same inside a text, so chunks begin at blanks only."""
    other = json.load(open(BPE))
    other["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    assert repair.tokenizer(str(path))[0].marks == b"" and repair.tokenizer(BPE)[0].marks == repair.MARKS.encode()


def test_lattices_are_filtered_in_parts(vocabulary, monkeypatch):
    """New chunks are filtered some bytes at a time, and draws are those of all at once."""
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(chr(c) for c in rng.integers(97, 103, n)) for n in rng.integers(1, 30, 40)) for _ in range(20)]
    data, offsets = flat_of([*texts, "", "é" * 500])
    keys = np.arange(len(offsets) - 1, dtype=np.uint64)
    whole = pieces.Lattices(vocabulary, 1.0).sample(data, offsets, keys, 5)
    at_once = []

    def counted(codes, own=pieces._prefix):
        at_once.append(len(codes))
        return own(codes)

    monkeypatch.setattr(pieces, "_prefix", counted)
    monkeypatch.setattr(pieces, "ADDED_CHARS", 300)
    parts = pieces.Lattices(vocabulary, 1.0).sample(data, offsets, keys, 5)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(at_once) > 10 and sorted(at_once)[-2] <= 300


def test_tasks_release_memory_when_they_end(monkeypatch):
    done = []
    monkeypatch.setattr(bytestream, "_trim", lambda: done.append("released"))
    run = bytestream.released(lambda batches: (done.append(b) or b for b in batches))
    assert list(run([1, 2])) == [1, 2]
    assert done == [1, 2, "released"]
