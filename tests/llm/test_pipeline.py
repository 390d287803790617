"""The pipeline's stages, each held against a plain version on what its predecessor kept."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from quarrykit.llm import packing, queries

from . import brute
from .conftest import frame
from .test_texts import plain_line_chunks

STAGES = dict(corpus_pipeline.STAGES)
L = "\n".join(f"the repeated line number {i} of a passage" for i in range(12))
UNIQUE = "unique words of a text that stands alone and has enough of them to be told apart"


def told(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def plain_lines(rows):
    """(id, text) after removal: of each chunk the first place by id (null last), hash of the text and number stays."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, left = {}, {}
    for doc, text in order:
        for k, c in enumerate(plain_line_chunks(text)):
            if len(c) >= 2:
                seen.setdefault("\n".join(c), (doc, text, k))
        left[doc, text] = "\n".join("\n".join(c) for k, c in enumerate(plain_line_chunks(text)) if len(c) < 2 or seen["\n".join(c)] == (doc, text, k))
    return Counter((doc, left[doc, text]) for doc, text in rows)


def plain_near(rows):
    """Of each group the texts of the smallest id, equal rows once; null ids stay."""
    texts = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1]))
    sets = [brute.shingles(t, 5) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (doc, _) in enumerate(texts):
        least[root(i)] = min(least.get(root(i), doc), doc)
    kept = Counter(r for i, r in enumerate(texts) if least[root(i)] == r[0])
    return kept + Counter(r for r in rows if r[0] is None)


@pytest.fixture(scope="module")
def run(spark, docs):
    out, seen = {"input": docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, "").cache()
        if name != "packing":
            assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
        out[name] = seen.collect()
    return out


def test_language_rejects_what_has_no_letter(run):
    want = [r for r in run["input"] if r["text"] and any(c.isalpha() for c in r["text"])]
    assert told(run["language_id"]) == told(want)
    given = {(r["doc_id"], r["text"]): r["lang"] for r in want}
    assert all(r["lang"] and r["lang"] == (given[r["doc_id"], r["text"]] or r["lang"]) for r in run["language_id"])


def test_lines_equal_plain(run):
    assert told(run["line_dedup"]) == plain_lines([(r["doc_id"], r["text"]) for r in run["language_id"]])
    assert all(r["n_chars"] == len(r["text"]) for r in run["line_dedup"])


def test_near_duplicates_equal_plain(run):
    assert told(run["near_dedup"]) == plain_near([(r["doc_id"], r["text"]) for r in run["line_dedup"]])


def test_mixing_keeps_texts_whole_or_in_runs(run):
    texts, out = defaultdict(list), defaultdict(list)
    for r in run["near_dedup"]:
        texts[r["doc_id"]].append(r["text"])
    for r in run["mixing"]:
        out[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"]) and any(r["text"] in t for t in texts[r["doc_id"]])
    for doc, own in out.items():
        assert sum(len(brute.words(t)) for t in own) <= 3 * sum(len(brute.words(t)) for t in texts[doc])
    taken, size = Counter(), Counter()
    for name, counter in (("mixing", taken), ("near_dedup", size)):
        for r in run[name]:
            counter[r["source"]] += len(brute.words(r["text"]))
    from quarrykit.llm.mixing import targets

    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    for name, want in zip(names, targets([size[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
        assert abs(taken[name] - want) <= max(40, 0.02 * want), name


def test_packing_holds_all_tokens(run):
    own = packing.encoder(queries.tokenizer_path()).tokenizer
    want = Counter()
    for r in run["mixing"]:
        ids = [*own.encode(r["text"], add_special_tokens=False).ids, 1]
        want.update((r["doc_id"], i // 4096, brute.crc(ids[i : i + 4096])) for i in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run["packing"]) == want


def test_repeated_and_null_ids_keep_their_own_texts(spark):
    rows = [(1, L, "en", "s0"), (2, UNIQUE, "en", "s0"), (2, L, "en", "s0"), (None, L, "en", "s0"), (None, L, "en", "s0"), (3, UNIQUE + " but for more words", "en", "s0")]
    cut = STAGES["line_dedup"](spark, frame(spark, rows), "").collect()
    want = plain_lines([(r[0], r[1]) for r in rows])
    assert told(cut) == want and want[2, UNIQUE] == 1 and want[1, L] == 1 and want[None, L] == 0
    near = STAGES["near_dedup"](spark, frame(spark, [*rows, rows[0], rows[1]]), "").collect()
    assert told(near) == Counter({(1, L): 1, (2, UNIQUE): 1, (3, UNIQUE + " but for more words"): 1, (None, L): 2})


def test_columns_of_any_name_pass_through(spark):
    names = ["target", "taken", "block", "passes", "_s", "_kept", "_size", "_lang_pred", "row", "doc", "kept", "gone", "cs", "part", "digest"]
    df = frame(spark, [(i, f"{UNIQUE} {i}\nword {i}", "en", f"s{i % 2}") for i in range(12)]).select("doc_id", "text", "lang", "source", "n_chars")
    df = df.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names), name


def test_empty(spark, empty):
    seen = empty
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, "")
    assert seen.count() == 0
