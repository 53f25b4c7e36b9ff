"""The pipeline's stages, each held against what it says of its own input."""

import numpy as np

import corpus_pipeline as P
from rockframe.llm import quality
from rockframe.runtime import materialize
from tests.llm.test_operators import BYTE, base_pii, check_packed  # noqa: F401


def test_stages(spark, sf_dir, docs):
    names, current = [n for n, _ in P.STAGES], docs
    assert len(names) == 5
    seen = [docs.toPandas()]
    for _, stage in P.STAGES:
        current = materialize(stage(spark, current, sf_dir))
        seen.append(current.toPandas())
    raw, good, spoken, single, clean, packed = seen
    assert all(list(x.columns) == list(raw.columns) for x in (good, spoken, single, clean))
    verdict = quality.judge(docs, keep=["doc_id"]).toPandas()
    assert set(good["doc_id"]) == set(verdict[verdict["kept"]]["k0"])
    assert set(spoken["doc_id"]) <= set(good["doc_id"]) and len(spoken) > 0.98 * len(good)
    sets = {i: frozenset(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for i, t in zip(spoken["doc_id"], spoken["text"], strict=True)}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    kept, gone = sorted(single["doc_id"]), sorted(set(spoken["doc_id"]) - set(single["doc_id"]))
    assert all(any(j < i and alike(sets[i], sets[j]) for j in sets) for i in gone)
    assert not [(a, b) for k, a in enumerate(kept) for b in kept[k + 1 :] if alike(sets[a], sets[b])]
    assert set(clean["doc_id"]) == set(single["doc_id"]) and not any(base_pii(t) for t in clean["text"])
    assert np.array_equal(clean["n_chars"], clean["text"].str.len())
    check_packed(packed, clean["text"])
