import random

import pytest

from stowage.operators.flat_names import resolve_flat_names


def greedy(names, existing):
    """Brute force: take the name, or count up until a free one is found."""
    used, out = set(existing), []
    for name in names:
        cut = name.rfind(".")
        stem, ext = (name[:cut], name[cut:]) if cut > 0 else (name, "")
        candidate, n = name, 2
        while candidate in used:
            candidate, n = f"{stem} ({n}){ext}", n + 1
        used.add(candidate)
        out.append(candidate)
    return out


def resolve(spark, names, existing):
    rows = spark.createDataFrame([(i, f"/x/{n}", n) for i, n in enumerate(names)], "ord long, src_path string, name string")
    there = spark.createDataFrame([(n,) for n in existing], "name string")
    got = resolve_flat_names(rows, there, ["ord"]).orderBy("ord").collect()
    return [r.dst_name for r in got]


@pytest.mark.parametrize("names,existing", [
    (["a.txt", "a (2).txt", "a.txt", "a.txt"], []),
    (["a.txt", "a.txt", "a (2).txt", "a.txt"], []),
    (["a.txt", "a.txt", "a (2).txt", "a (2).txt", "a (2) (2).txt", "a.txt"], ["a (3).txt"]),
    ([".bashrc", ".bashrc", "x", "x"], ["x", "x (2)", "x (4)"]),
])
def test_known_collisions(spark, names, existing):
    assert resolve(spark, names, existing) == greedy(names, existing)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a.txt", "a (2).txt", "a (3).txt", "a (2) (2).txt", "a (1).txt", "b.md", "b (5).md", "c", "c (2)", "d.tar.gz"]
    names = [rng.choice(pool[: rng.randint(2, len(pool))]) for _ in range(90)]
    existing = rng.sample(["a.txt", "a (4).txt", "b (2).md", "c", "c (3)", "a (2) (3).txt", "d.tar (2).gz"], 4)
    assert resolve(spark, names, existing) == greedy(names, existing)
