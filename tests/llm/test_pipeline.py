"""The pipeline against a brute-force version of all its stages but the trained one."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from conftest import DATA
from rasterloom.llm import mixing, toxicity
from rasterloom.llm.common import stage, table
from rasterloom.llm.queries import tokenizer_path

from .test_exact import brute_groups

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are missing")


def words2(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs, labels = table(spark, str(SF), "documents"), table(spark, str(SF), "labels")
    fine = {r["doc_id"] for r in toxicity.score(docs, labels).filter("predicted = 0").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in fine]
    kept = {r[0] for r in brute_groups([(r["doc_id"], r["text"]) for r in rows]) if r[3]}
    rows = [r for r in rows if r["doc_id"] in kept]
    windows = set()
    for item in table(spark, str(SF), "benchmark").collect():
        own = words2(item["text"])
        n = min(10, len(own))
        windows |= {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        own = words2(text)
        return any(tuple(own[i : i + n]) in windows for n in sizes for i in range(len(own) - n + 1))

    rows = [r for r in rows if not hit(r["text"])]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sources = defaultdict(list)
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
        sources[r["source"]].append(r)
    names = sorted(sources)
    total = {s: sum(size[r["doc_id"]] for r in sources[s]) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    order = sorted(names, key=lambda s: 2 * total[s] / weight[s])
    left = 1.5 * sum(total.values())
    target = {}
    for i, s in enumerate(order):
        level = left / sum(weight[x] for x in order[i:])
        target[s] = min(2.0 * total[s], level * weight[s])
        left -= target[s]
    copies = []
    for s in names:
        at = 0
        for _ in range(2):
            for r in sources[s]:
                n = size[r["doc_id"]]
                taken = max(0, min(n, math.floor(target[s]) - at))
                copies += [r] * (taken > 0 and 2 * taken >= n)
                at += n
    library = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for r in sorted(copies, key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(SF)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)


def test_stages_take_awkward_rows(spark, documents, nothing):
    for docs in (documents, nothing):
        for name, apply in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(apply(spark, docs, str(SF)), name)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).count() == docs.count()
