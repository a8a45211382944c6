import hashlib
import subprocess
import sys

import numpy as np
from plain import SF, components, drop_lines

import corpus_pipeline
from lantern.llm.common import landed
from lantern.llm.decontaminate import Pattern, normalise
from lantern.llm.queries import ORACLES, QUERIES, tokenizer_path


def test_run_against_plain_statements(spark, documents):
    left = dict(drop_lines(documents, 10).items())
    texts = {d: t for d, (_, _, t) in left.items()}
    kept = {d for d, (_, c) in components(texts, 5, 4, 5).items() if c == d}
    items = [normalise(r[0]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    clean = {d for d in kept if not any(Pattern(i).best(normalise(texts[d]))[0] <= int(0.05 * len(i)) for i in items if i)}
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for d in clean:
        ids = library.encode(texts[d], add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(clean) < len(documents)


def test_stages_keep_the_columns_of_documents(spark, awkward):
    docs = awkward.selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(0 as long) n_chars")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = landed(stage(spark, some, SF), name)
            assert out.columns == some.columns and out.count() <= some.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() == 0  # nothing labelled, so no language is known


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_library_does_not_need_the_package():
    code = ("import sys; sys.modules['lantern.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import importlib.util as u; f = u.find_spec\n"
            "u.find_spec = lambda n, *a: None if n in ('lantern.llm', 'corpus_pipeline') else f(n, *a)\n"
            "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= 146 and out[-1] == "False"
