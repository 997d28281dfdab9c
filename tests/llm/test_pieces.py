import hashlib

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import pieces as P
from logsift.llm import queries as Q

from llm_data import SF_SMALL, nothing, odd, texts  # noqa: F401

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
OWN, LIBRARY = P.MergeVocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_query_equals_the_library(spark, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {r.doc_id: r for r in Q.op2_pieces(spark, SF_SMALL).collect()}
    for i, t in texts:
        ids = LIBRARY.encode(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
        assert rows[i].library_agrees in (True, None)


ALPHABET = st.sampled_from([*"ab \t\n▁éß漢😀\x00́٣“the and", "▁▁", "  ", "the ", " and", "<s>", "</s>", "<0x41>", "�", "\r\n", "a" * 40])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=4)), max_size=30).map("".join))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text)
    assert OWN.encode(text) == ids and OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260)), max_size=12))
def test_any_ids(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_long_runs():
    for text in ("a" * 100_000, " " * 5_000 + "x", "the" * 20_000, "漢" * 3_000, "a\n" * 10_000):
        assert OWN.encode(text) == LIBRARY.encode(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 50)
    monkeypatch.setattr(P, "AT_A_TIME", 100)
    own = P.MergeVocabulary(MODEL)
    texts = [f"word{i} other{i * 7} the end" for i in range(400)]
    assert list(own.encode_all(texts)) == [LIBRARY.encode(t) for t in texts]
    assert len(own._words) < 100 and len(own._memory) < 100


def test_odd_rows(spark, odd, nothing):
    rows = P.round_trip(odd, PATH, check_every=1, with_ids=True).collect()
    assert len(rows) == odd.count() and all(r.library_agrees for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    encoded = P.encode(odd, PATH)
    decoded = sorted((str(r.id), r.text) for r in P.decode(encoded, PATH).collect())
    assert decoded == sorted((str(r.doc_id), LIBRARY.decode(LIBRARY.encode(r.text or ""))) for r in odd.collect())
    assert P.round_trip(nothing, PATH).collect() == [] and P.encode(nothing, PATH).collect() == []
    assert P.decode(spark.createDataFrame([(1, None)], "id long, ids array<int>"), PATH).first().text == ""


def test_other_models_are_refused():
    piece = b"\x0a\x03\x0a\x01a"
    for settings_ in (b"\x12\x02\x18\x01", b"\x12\x02\x18\x02", b"\x12\x05\x18\x02\x98\x02\x01"):
        with pytest.raises(ValueError):
            P.MergeVocabulary(piece + settings_)


def test_query_checks_every_row(spark):
    assert {r.library_agrees for r in Q.op2_pieces(spark, SF_SMALL).collect()} == {True}


def test_stage_checks_every_row(spark, odd):
    stage = dict(corpus_pipeline.STAGES)["piece_ids"]
    assert {r.library_agrees for r in stage(spark, odd, SF_SMALL).collect()} == {True}


def test_a_disagreement_is_seen_and_stays(monkeypatch):
    """The row keeps what the agenda made, right or wrong: nothing of the library takes its place."""
    class Shared:
        value = MODEL

    right = P.MergeVocabulary._encode_some

    def wrong(self, texts):
        out = right(self, texts)
        self._words["end"] = (*self._words["end"], 300)
        return out

    monkeypatch.setattr(P.MergeVocabulary, "_encode_some", wrong)
    monkeypatch.setattr(P, "_LOADED", {})
    texts = ["the", "the end of the line", "", "another line of words"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": texts})
    (got,) = P._round_tripper(Shared, 1, True)(iter([batch]))
    assert got.column("library_agrees").to_pylist() == [True, False, True, True]
    planted = [*LIBRARY.encode("the end"), 300, *LIBRARY.encode("of the line")]
    assert got.column("ids").to_pylist() == [planted if t == texts[1] else LIBRARY.encode(t) for t in texts]
    assert got.column("ids_sha256").to_pylist()[1] == hashlib.sha256(",".join(map(str, planted)).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.sampled_from(["\n", " \n", "\n ", "\n\n", " "]), st.text(max_size=3)), max_size=30).map("".join))
def test_words_and_line_breaks_give_the_same_as_runs(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text)
    assert list(OWN.round_trips([text, text])) == [(ids, ",".join(map(str, ids)), LIBRARY.decode(ids))] * 2


def test_bytes_that_are_no_text(spark):
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert P.round_trip(bad, PATH).first().library_agrees and P.encode(bad, PATH).first().ids == LIBRARY.encode("a\ufffdb")
