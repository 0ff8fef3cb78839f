"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import corpus_pipeline
import pytest

from pixelframe.llm import near_copies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sample(n):
    """Texts with copies in which 0 to 8 words are replaced, chains of such copies, and short ones."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(50_000)}"
    texts = ["", "one", "One", "a b c d e", "a b c d f"]
    while len(texts) < n:
        base = [word() for _ in range(r.choice([30, 100, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(5)):
            new = list(base)
            for at in r.sample(range(len(base)), r.randrange(9)):
                new[at] = word()
            texts.append(" ".join(new))
            base = new if r.random() < 0.5 else base
    return texts


def brute(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("chunk", [2, 1024])
def test_groups_against_brute_force(spark, chunk):
    texts = sample(300)
    got = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk_sets=chunk).collect()
    first = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        first.setdefault(r["near_group"], r["doc_id"])
    assert [first[r["near_group"]] for r in sorted(got, key=lambda r: r["doc_id"])] == brute(texts)


def test_stage_keeps_the_first_of_each_group(spark):
    texts = sample(200)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[9])], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert kept == set(brute(texts))


def test_simhash_links_propose_near_copies(spark):
    """Without MinHash bands the SimHash step alone finds texts that differ in one word of very many."""
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    changed = [*words[:-1], "other"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(reversed(words))), (4, None)], "doc_id long, text string")
    sets = near_copies._sets(docs, "doc_id", "text", sketch=True)
    links = {frozenset(x) for x in near_copies._fingerprint_links(sets.where("size > 0")).collect()}
    key = {x["doc_id"]: x["key"] for x in sets.collect()}
    assert links == {frozenset((key[1], key[2]))}
