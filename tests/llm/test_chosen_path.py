"""The chosen-path join against all pairs."""

import math
import random
import re

import numpy as np
import pytest

from echogrid.llm import chosen_path

SCHEMA = "doc_id long, text string, component_id string, kept string, key long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    sets = [shingles(r[1], width) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    out = []
    for i, (r, s) in enumerate(zip(rows, sets, strict=True)):
        component = least.get(root(i)) if s else r[0]
        out.append((r[0], len(s), component, r[0] == component))
    return sorted(out, key=str)


def sample(seed=3):
    """Groups of copies that are near, at the threshold and below it; a large group; chains; texts without words; repeats."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = []
    for n in (6, 9, 30, 120, 400):
        for share in (0.02, 0.06, 0.1, 0.2):
            base = text(n)
            for _ in range(8):
                copy = list(base)
                for i in r.sample(range(n), max(1, int(share * n / 2))):
                    copy[i] = r.choice(vocabulary)
                texts.append(" ".join(copy))
    base = text(150)
    for _ in range(220):
        copy = list(base)
        copy[r.randrange(150)] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    # a frame that many texts share, below the threshold, and chains of small steps
    frame = text(60)
    texts += [" ".join(frame + text(25)) for _ in range(150)]
    step = text(80)
    for k in range(30):
        step = step[:k] + [f"x{k}"] + step[k + 1 :]
        texts.append(" ".join(step))
    texts += ["", None, " \t\n", "one", "ONE", "two words", "Two  Words\n", "three words here", texts[5].upper(), texts[5]]
    rows = [(i, t, "c", None, 0) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "c", None, 0), (3, texts[40], None, None, None), (None, texts[0], None, None, None), (None, "no other has this text", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    rows = sample()
    got = chosen_path.near_copies(spark.createDataFrame(rows, SCHEMA), width=width).collect()
    assert sorted(map(tuple, got), key=str) == [(a, b, c, d if a is not None else c is None) for a, b, c, d in brute(rows, width, 80)]


def test_small_limits_take_every_way(spark, monkeypatch):
    """Nodes branch on, lie in parts and are compared at last whatever their size; the result stays."""
    rows = sample(5)[600:]
    want = [(a, b, c, d if a is not None else c is None) for a, b, c, d in brute(rows, 2, 80)]
    for small, levels in ((12, 40), (12, 1)):
        for name, value in (("SMALL", small), ("HUB", 5), ("PART", 16), ("CELL", 2000), ("LEVELS", levels)):
            monkeypatch.setattr(chosen_path, name, value)
        assert sorted(map(tuple, chosen_path.near_copies(spark.createDataFrame(rows, SCHEMA), width=2).collect()), key=str) == want


def test_empty_table_and_a_long_text(spark):
    assert chosen_path.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"w{i}" for i in range(400_000))
    got = chosen_path.near_copies(spark.createDataFrame([(2, long, "", "", 0), (1, long + " more", "", "", 0), (3, "w1 w2", "", "", 0)], SCHEMA), width=2).collect()
    assert sorted(map(tuple, got)) == [(1, 400_000, 1, True), (2, 399_999, 1, False), (3, 1, 3, True)]


def test_coordinates_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(2)
    for shared in (100, 60, 20):
        agree = []
        for _ in range(20):
            tokens = r.integers(0, 2**63, 200 - shared, dtype=np.uint64)
            signs = [np.frombuffer(x, "<u2") for x in chosen_path.signatures_of([tokens[:100], tokens[100 - shared :]])]
            agree.append((signs[0] == signs[1]).mean())
        assert abs(np.mean(agree) - shared / (200 - shared)) < 0.04


def test_one_tree_finds_pairs_as_often_as_planned():
    """The number of trees rests on this probability."""
    r = np.random.default_rng(6)
    roots, miss = chosen_path.common.mix(np.arange(1, 401, dtype=np.uint64)), []
    for _ in range(30):
        signs = np.zeros((2, 128), np.uint16)
        signs[1] = r.random(128) >= 0.8
        owner, node = np.repeat([0, 1], 400), np.tile(roots, 2)
        tree = np.tile(np.arange(400), 2)
        for _ in range(4):
            more_owner, more_node = chosen_path.children(np.arange(len(node)), node, signs[owner], 80)
            owner, tree, node = owner[more_owner], tree[more_owner], more_node
        miss.append(1 - len(set(tree[np.isin(node, np.intersect1d(node[owner == 0], node[owner == 1]))].tolist())) / 400)
    assert abs(math.log(1e-5) / math.log(np.mean(miss)) - chosen_path.trees_for(0.99999, 4, 80)) < 2
