import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from barspan.llm import bpe, common, packing, sharding  # noqa: E402

PATH = P.path("word_bpe_49k.json")
ODD = ["", "  ", "a\x1cb c", "foo<|endoftext|>bar <|startoftext|>", "ΑΣ ΣΑΣ", "İstanbul", "don't we'll I'M 'S", "12３ ½ ²", " x　y\x85z\xa0", "日本語 हिन्दी", "a​b", "😀😀", "x" * 3000, "!!!???...", "\x00\x01", "ß ẞ ﬁ", "__a_b", "ÁB", " ́a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(PATH)


def same(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    raw, decoded = own.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert decoded == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_encodes_as_the_library(library, own, text):
    same(library, own, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(min_codepoint=1, max_codepoint=0x24FF, exclude_categories=("Cs", "Cn"))))
def test_encodes_any_text_as_the_library(library, own, text):
    same(library, own, text)


def test_encode_takes_odd_rows(spark, odd_docs, no_docs, library):
    rows = bpe.encode(odd_docs, PATH).collect()
    texts = sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == texts
    back = bpe.decode(bpe.encode(odd_docs, PATH, outputs=("ids", "decoded")).withColumnRenamed("decoded", "was"), PATH).collect()
    assert all(r.decoded == r.was for r in back)
    assert bpe.encode(no_docs, PATH).count() == 0


SPECIAL = ["don't WE'LL 'S''s it's.", "a.###  b,\r\n\tÄÖß ÿÀ×÷ no1st 12", "foo<|endoftext|>bar <|start", "ü\u0308 é", "a\x0bb\x0cc", "ſ ŉ µª"]


@pytest.mark.parametrize("text", [*ODD, *SPECIAL])
@pytest.mark.parametrize("limit", [3, 1000])
def test_packing_encodes_as_the_library(library, text, limit):
    encode = packing.text_encoder(library, limit)
    for t in (text, text + " ¿Él? " + text, text + " —" + text):
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n'slrevmdt<|>.1"), st.characters(min_codepoint=1, max_codepoint=0x24F, exclude_categories=("Cs", "Cn")))))
def test_packing_encodes_any_text_as_the_library(library, text):
    assert np.frombuffer(packing.text_encoder(library)(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", SPECIAL)
def test_own_encoder_takes_special_texts_as_the_library(library, own, text):
    for t in (text, text + " ¿Él? " + text, text + " —" + text):
        same(library, own, t)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n'slrevmdt<|>.1"), st.characters(min_codepoint=1, max_codepoint=0x24F, exclude_categories=("Cs", "Cn")))))
def test_own_encoder_takes_plain_texts_as_the_library(library, own, text):
    same(library, own, text)


def test_own_encoder_merges_each_plain_word_once(library):
    own, seen = bpe.WordBpe(PATH), []
    merge = own.encode_word
    own.encode_word = lambda word: seen.append(word) or merge(word)
    for k in range(50):
        same(library, own, f"Größe{k}, niño {k} don't. Word-{k}!\n")
    assert len(seen) == len(set(seen))
    assert not own.chunks
    same(library, own, "Größe7, — niño")
    assert len(own.chunks) == 3


def test_plain_words_go_to_the_model_alone(library):
    class Counting:
        """Counts what takes the whole tokenizer."""

        model, normalizer, pre_tokenizer, seen = library.model, library.normalizer, library.pre_tokenizer, 0
        get_added_tokens_decoder = library.get_added_tokens_decoder

        def encode(self, text, **more):
            self.seen += 1
            return library.encode(text, **more)

    counting = Counting()
    encode = packing.text_encoder(counting)
    for k in range(50):
        encode(f"Größe{k}, niño {k} don't. Word-{k}!\n" + "—" * (k == 7))
    assert counting.seen == 1


def test_another_normaliser_is_kept_to():
    from tokenizers import Tokenizer, normalizers

    cased = Tokenizer.from_file(PATH)
    cased.normalizer = normalizers.NFC()
    text = "Größe and niño, don't"
    assert np.frombuffer(packing.text_encoder(cased)(text), "<u4").tolist() == cased.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("areas", [{}, {"area_bins": 6, "exchange_bins": 3, "merge": 4}])
def test_packing_is_whole_gapless_and_near_its_bound(spark, sf_dir, library, areas):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(packing.token_pieces(docs, PATH), **areas).collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    assert sorted((r.doc_id, r.start) for r in rows) == sorted((i, s) for i, x in ids.items() for s in range(0, len(x), 4096))
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + 4096]
        assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert check_packing(rows, 4096) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_odd_rows_and_sequences(spark, odd_docs, no_docs):
    pieces = common.cut(packing.token_pieces(odd_docs, PATH, with_ids=True), "pieces")
    plan = packing.pack(pieces, numbered=True)
    assert check_packing(plan.collect(), 4096) > 0 and plan.count() == pieces.count()
    made = packing.sequences(pieces, plan).collect()
    assert sum(r.n_tokens for r in made) == pieces.agg({"length": "sum"}).first()[0]
    # Every piece comes back whole, those of null and repeated ids too, at its offset.
    ids = {r.sequence_id: r.ids for r in made}
    by_number = {r.spread: list(r.ids) for r in pieces.collect()}
    assert all(ids[r.sequence_id][r.offset : r.offset + r.length] == by_number[r.spread] for r in plan.collect())
    assert packing.pack(packing.token_pieces(no_docs, PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound_never_exceeds_the_best_packing(lengths):
    def fits(rest, bins, n):
        if not rest:
            return True
        tried = set()
        for b in range(n):
            if bins[b] + rest[0] <= 20 and bins[b] not in tried:
                tried.add(bins[b])
                bins[b] += rest[0]
                if fits(rest[1:], bins, n):
                    return True
                bins[b] -= rest[0]
        return False

    lengths = sorted(lengths, reverse=True)
    best = next(n for n in range(1, 10) if fits(lengths, [0] * n, n))
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= best
    got = packing.best_fit_decreasing(np.array(lengths), 20)
    assert max(np.bincount(got, weights=lengths)) <= 20 and got.max() + 1 <= best * 3 // 2 + 1


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 300])
def test_shards_are_even_gapless_and_whole(spark, odd_docs, no_docs, bucket_bytes):
    rows = sharding.shard(odd_docs, shards=4, bucket_bytes=bucket_bytes).collect()
    assert len(rows) == 13 and len({(r.shard, r.slot) for r in rows}) == 13
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert set(rows[0].asDict()) == {*odd_docs.columns, "shard", "slot"}
    assert sharding.shard(no_docs).count() == 0


def test_shards_are_shuffled_and_written(spark, tmp_path):
    sharded = sharding.shard(spark.range(2000).withColumnRenamed("id", "doc_id"), shards=8, bucket_bytes=64 * 300)
    rows = sharded.orderBy("shard", "slot").collect()
    order = [r.doc_id for r in rows]
    assert sorted(order) == list(range(2000)) and sum(a < b for a, b in zip(order, order[1:], strict=False)) < 1200
    sharding.write_shards(sharded, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").filter("shard = 3").count() == 250


def test_the_query_digests_as_the_library_does(spark, sf_dir, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op9_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
