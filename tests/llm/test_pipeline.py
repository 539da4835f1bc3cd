"""The corpus pipeline on a real table, each stage against a plain version of what it decides, and the whole run."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from foliospark.llm import langid, mixing, secrets
from tests.llm.test_text_operators import brute_groups, sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage, as rows."""
    import corpus_pipeline as c

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in c.STAGES:
        done = c.stored(stage(spark, docs, SF))
        out.append((name, docs.collect(), done.collect()))
        docs = done
    return {n: (a, b) for n, a, b in out}


def test_language_keeps_what_a_model_fits(spark, stages):
    before, after = stages["language"]
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    pred, _, low, _ = model([r.text or "" for r in before])
    letters = [sum(ch.isalpha() for ch in r.text or "") for r in before]
    bound = dict(zip(model.scorer.langs, model.bound, strict=True))
    keep = {r.doc_id: p for r, p, e, n in zip(before, pred, low, letters, strict=True) if n and (n < model.sure_from or e <= bound[p])}
    assert {r.doc_id: r.lang for r in after} == keep and len(after) >= 0.95 * len(before)


def test_near_duplicates_keep_the_first_of_each_group(stages):
    before, after = stages["near_duplicates"]
    root = brute_groups(sets(before))
    assert sorted(r.doc_id for r in after) == sorted(i for i, r in root.items() if i == r)


def test_secrets_masks_values_of_one_owner(stages):
    before, after = stages["secrets"]
    found = {}
    for r in before:
        for kind, pattern, group, least in secrets.KINDS:
            for m in re.finditer(pattern.replace("((?i:password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))").replace("{24,}+", "{24,}"), r.text or ""):
                if len(m[group]) >= least:
                    found.setdefault(m[group], []).append((r, m.end() - len(m[group]), m.end()))
    live = {v for v, at in found.items() if len({r.source for r, *_ in at}) == 1 and len({r.doc_id for r, *_ in at}) <= 16 and len(v) >= 16 and len(set(v)) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)}
    text = {r.doc_id: r.text for r in before}
    for i, t in text.items():
        spans = sorted((a, b) for v in live for r, a, b in found[v] if r.doc_id == i)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        text[i] = out + (t or "")[at:] if spans else t
    assert {r.doc_id: r.text for r in after} == text
    assert all(r.n_chars == len(r.text) for r in after if "[secret]" in r.text)


def test_mixing_draws_by_the_raked_rates(stages):
    before, after = stages["mixing"]
    cell = lambda r: (r.source or "", r.lang or "", topic(r.text or ""))

    def topic(t):
        n = {k: sum(t.lower().count(w) for w in ws) for k, ws in mixing.TOPICS.items()}
        best = max(n.values())
        return "general" if best == 0 or best * mixing.STRETCH < len(t) else next(k for k, c in n.items() if c == best)

    def count(t):
        whole = 50 * len(t) + 98 * (len(t.encode()) - len(t)) - 75 * t.count(" ")
        return max(whole // 100, (len(t) + 3) // 4)

    tokens = {}
    for r in before:
        tokens[cell(r)] = tokens.get(cell(r), 0) + count(r.text or "")
    keys = [k for k, n in tokens.items() if n]
    base = np.array([tokens[k] for k in keys], float)
    share = base / base.sum()
    for _ in range(200):
        for d, p in enumerate(mixing.TEMPER.values()):
            values = [k[d] for k in keys]
            power = {v: sum(base[i] for i in range(len(keys)) if values[i] == v) ** p for v in set(values)}
            now = {v: sum(share[i] for i in range(len(keys)) if values[i] == v) for v in set(values)}
            share = np.array([share[i] * power[v] / sum(power.values()) / now[v] for i, v in enumerate(values)])
    rate = dict(zip(keys, share / (base / base.sum()), strict=True))
    import hashlib

    want = []
    for r in before:
        x = rate.get(cell(r), 0.0)
        draw = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        want += [r.doc_id] * (int(x) + (draw < x - int(x)))
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_packing_holds_every_token_of_every_copy_once(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for p in after:
        pieces.setdefault(p.doc_id, []).append(p)
    for i in {r.doc_id for r in before}:
        own = [r for r in before if r.doc_id == i]
        ids = t.encode(own[0].text or "", add_special_tokens=False).ids + [1]
        assert sum(p.length for p in pieces[i]) == len(own) * len(ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces[i])


def test_run_is_its_stages(spark, stages):
    import corpus_pipeline as c

    assert sorted(map(tuple, c.run(spark, SF).select("doc_id", "start", "length").collect())) == sorted((r.doc_id, r.start, r.length) for r in stages["packing"][1])
