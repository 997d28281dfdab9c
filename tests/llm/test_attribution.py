import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logsift.llm import attribution as A
from logsift.llm import queries as Q

from llm_data import SF_SMALL, nothing, odd, texts  # noqa: F401

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENCODER = A.RankEncoder(open(RANKS, "rb").read(), PATTERN)
OTHER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OTHER.encode_special_tokens = True


def brute(text, rule, sections=None):
    """Tokens of each section by comparing every token of another library's offsets with every section."""
    if sections is None:
        sections, at = [], 0
        lines = text.split("\n")
        for k, line in enumerate(lines):
            end = at + len(line) + (k < len(lines) - 1)
            sections.append((at, end))
            at = end
    got = [[0, 0] for _ in sections]
    for a, b in OTHER.encode(text, add_special_tokens=False).offsets:
        hit = [(min(b, y) - max(a, x), -i) for i, (x, y) in enumerate(sections) if min(b, y) > max(a, x)]
        if hit:
            i = -{"first": hit[0], "last": hit[-1], "largest": max(hit)}[rule][1]
            got[i][0] += 1
            got[i][1] += a < sections[i][0] or b > sections[i][1]
    return [(i, x, y, *g) for i, ((x, y), g) in enumerate(zip(sections, got, strict=True))]


def rows_of(df):
    return sorted(((r.id, r.section, r.start_char, r.end_char, r.n_tokens, r.n_crossing) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, texts):
    got = sorted(tuple(r) for r in Q.op6_attribution(spark, SF_SMALL).collect())
    assert got == sorted((i, *x) for i, t in texts for x in brute(t or "", "largest"))


@pytest.mark.parametrize("rule", A.RULES)
def test_rules_on_random_texts(rule):
    draw = random.Random(1)
    for _ in range(400):
        text = "".join(draw.choices([*"ab \n\n\té漢😀\x00.", "the ", "\r\n", "\n \n"], k=draw.randrange(30)))
        first, last = A.line_sections(text.encode())
        got, crossing = A.attribute(*ENCODER.spans(text.encode()), first, last, rule)
        assert [(i, *x) for i, x in enumerate(zip(first, last, got, crossing, strict=True))] == brute(text, rule)
        assert got.sum() == len(ENCODER.encode(text))


def test_given_sections_with_gaps(spark):
    draw = random.Random(2)
    rows = []
    for i in range(60):
        text = "".join(draw.choices([*"ab \né😀", "the ", " and"], k=25))
        cuts = sorted(draw.choices(range(len(text) + 1), k=6))
        rows.append((i, text, [(cuts[0], cuts[1]), (cuts[2], cuts[3]), (cuts[4], cuts[5])]))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    for rule in A.RULES:
        want = sorted(((i, *x) for i, t, s in rows for x in brute(t, rule, sorted(s))), key=str)
        assert rows_of(A.token_counts(df, RANKS, PATTERN, rule, "parts")) == want


def test_fields(spark):
    df = spark.createDataFrame([(1, "user", "héllo there"), (2, None, ""), (3, "", "x")], "doc_id long, role string, body string")
    joined = A.joined_fields(df, ["role", "body"])
    assert [r.text for r in joined.orderBy("doc_id").collect()] == ["user\nhéllo there", "\n", "\nx"]
    got = rows_of(A.token_counts(joined, RANKS, PATTERN, "first", "sections"))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 0, 0, 4), (1, 1, 5, 16), (2, 0, 0, 0), (2, 1, 1, 1), (3, 0, 0, 0), (3, 1, 1, 2)]


def test_odd_rows(odd, nothing):
    got = rows_of(A.token_counts(odd, RANKS, PATTERN))
    want = sorted(((r.doc_id, *x) for r in odd.collect() for x in brute(r.text or "", "largest")), key=str)
    assert got == want
    assert A.token_counts(nothing, RANKS, PATTERN).collect() == []
    with pytest.raises(ValueError):
        A.token_counts(odd, RANKS, PATTERN, "half")


def test_very_long_white_space():
    text = "x" + " " * 60_000 + "y"
    assert ENCODER.encode(text) == OTHER.encode(text, add_special_tokens=False).ids


def test_a_long_run_of_blanks_changes_no_other_token():
    """Texts that the two pattern engines split differently, with runs around the length that is cut out."""
    import public_tokenizers

    from logsift.llm.attribution import RankEncoder

    encoder = RankEncoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    odd = "\U0003e9e1's"
    a, b = f"{odd} some words, {odd}", f"{odd} and more\u0378's."
    plain = encoder.encode(a)
    for blank in (" ", "\n", "\t", "\u3000", " \n"):
        for n in (19_999, 20_000, 20_001, 60_000):
            run = (blank * n)[:n]
            whole = encoder.encode(a + run + b)
            assert whole[: len(plain)] == plain
            assert b"".join(encoder._bpe.decode_single_token_bytes(i) for i in whole) == (a + run + b).encode()
            short = encoder.encode(a + run[: 40 + n % 2] + b)
            tail = encoder.encode(run[-1] + b)
            assert whole[-len(tail) :] == tail == short[-len(tail) :]
            assert encoder.encode(run)[:1] and encoder.encode(a + run)[: len(plain)] == plain
    texts = [a + " " * n + b + " " * 30_000 + a for n in (5, 25_000)]
    for t in texts:
        assert b"".join(encoder._bpe.decode_single_token_bytes(i) for i in encoder.encode(t)) == t.encode()
