import importlib.util
import os
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
import sentencepiece

from logsift.llm import linededup, quality, simhash, tiling
from logsift.llm.common import read

from llm_data import SF_SMALL, nothing, odd  # noqa: F401
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components, brute_print
from test_tiling import brute_tiles

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    """Each stage again without Spark (the learnt scores are the classifier's own)."""
    docs = read(spark, SF_SMALL, "documents")
    score = {r.id: r.score for r in quality.score(docs, read(spark, SF_SMALL, "labels")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] >= 0.7]
    assert 0 < len(rows) < docs.count()
    rows = [(i, t) for i, _, _, t in brute_lines(rows, 10)]
    comp = brute_components({i: brute_print(t) for i, t in rows})
    rows = [(i, t) for i, t in rows if comp[i] == i]
    bench = [tiling.split_words(r.text.encode()) for r in read(spark, SF_SMALL, "benchmark").collect()]

    def leaked(t):
        own = tiling.split_words(t.encode())
        grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        return any(sum(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)) > 0.3 * len(w) and brute_tiles(own, w, 5) >= 0.8 * len(w) for w in bench)

    rows = [(i, t) for i, t in rows if not leaked(t)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert got == {i: library.encode(t) for i, t in rows}


def test_stages_keep_the_columns(spark, odd, nothing):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_dedup", "decontamination", "piece_ids"]
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()


def test_line_stage_counts_characters_again(spark, odd):
    out = corpus_pipeline.line_dedup(spark, odd, SF_SMALL).collect()
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert sorted(r.text for r in out if r.doc_id and r.doc_id >= 20) == sorted(r.kept_text for r in linededup.dedup_lines(odd).collect() if r.id and r.id >= 20)


def test_entry_works_without_the_subpackage(tmp_path):
    """The library without the operators: a copy of the rest still imports and lists its own queries."""
    for part in ("__spark_entry__.py", "logsift"):
        os.symlink(f"{ROOT}/{part}", tmp_path / part) if part.endswith(".py") else None
    package = tmp_path / "logsift"
    package.mkdir()
    for name in os.listdir(f"{ROOT}/logsift"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/logsift/{name}", package / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); sys.path[:] = [p for p in sys.path if p != {ROOT!r}]; s.loader.exec_module(m); q = m.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline'], q; assert m.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=120)


def test_all_eleven_are_registered():
    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    q = entry.queries()
    assert "pipeline" in q and [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(q) and {simhash.SHINGLE, simhash.MAX_BITS} == {3, 2}
