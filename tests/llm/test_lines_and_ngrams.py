import random

from creditloom.llm import line_dedup, ngram_join


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, edits, alphabet):
    chars = list(text)
    for _ in range(edits):
        at, how = random.randrange(len(chars)), random.random()
        if how < 0.4:
            chars[at] = random.choice(alphabet)
        elif how < 0.7:
            chars.insert(at, random.choice(alphabet))
        elif len(chars) > 4:
            del chars[at]
    return "".join(chars)


def test_banded_distance_matches_brute_force():
    random.seed(4)
    for edits in (1, 2, 3):
        left = ["".join(random.choices("abé日", k=random.randint(4, 60))) for _ in range(800)]
        right = [changed(x, random.randint(0, 6), "abé日") for x in left]
        near = line_dedup.within_edits([line_dedup.code_points(x) for x in left], [line_dedup.code_points(x) for x in right], edits)
        assert near.tolist() == [distance(x, y) <= edits for x, y in zip(left, right)]


def brute_lines(rows, edits, min_chars):
    spots = [((i is None, i if i is not None else 0, k, n), line) for k, (i, t) in enumerate(rows) for n, line in enumerate((t or "").split("\n")) if len(line) >= min_chars]
    lines = sorted({line for _, line in spots})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if abs(len(lines[a]) - len(lines[b])) <= edits and distance(lines[a], lines[b]) <= edits:
                root[find(lines[a])] = find(lines[b])
    first = {}
    for spot, line in sorted(spots):
        first.setdefault(find(line), spot)
    return {(spot[2], spot[3]) for spot, line in spots if first[find(line)] != spot}


def test_repeated_lines_match_brute_force(docs_of, monkeypatch):
    random.seed(6)
    monkeypatch.setattr(line_dedup, "BLOCK", 3)  # many blocks for the shared segments
    base = ["".join(random.choices("abcde é", k=random.randint(10, 30))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [changed(random.choice(base), random.choice([0, 0, 1, 2, 4]), "abcde é") for _ in range(random.randint(0, 4))]
        rows.append((i if i % 17 else None, "\n".join(lines) if i % 13 else None))
    rows += [(5, rows[5][1]), (70, "short\n\n" + base[0] + "\n" + base[0])]
    docs = docs_of(rows).coalesce(1)
    got = line_dedup.repeated_lines(docs, edits=2, min_chars=9).orderBy("row").collect()
    # createDataFrame keeps the order of rows inside one partition
    found = {(k, r["line_no"]) for k, x in enumerate(got) for r in (x.repeats or [])}
    assert found == brute_lines(rows, 2, 9)
    assert [x.n_removed for x in got] == [len(x.repeats or []) for x in got]


def test_equal_short_lines_are_repeats(docs_of):
    rows = [(k, f"All rights reserved.\n\n \t\nOwn {k}\nA line that is long enough for edits {k}.") for k in range(30)]
    rows += [(40, "All rights reserved!\nx"), (41, "x\nx\n\n")]
    got = {r.id: [(x.line_no, x.first_id, x.first_line) for x in r.repeats or []] for r in line_dedup.repeated_lines(docs_of(rows)).collect()}
    assert got[0] == [] and all(got[k] == [(0, 0, 0), (4, 0, 4)] for k in range(1, 30))
    assert got[40] == [] and got[41] == [(0, 40, 1), (1, 40, 1)]


def test_lines_are_taken_out(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nc", [1]), ("a", [0]), ("a\n", None), (None, [0])], "t string, n array<int>")
    assert [r[0] for r in df.select(line_dedup.without_lines(F.col("t"), F.col("n"))).collect()] == ["a\nc", "", "a\n", None]


def test_no_lines(docs_of):
    assert line_dedup.repeated_lines(docs_of([])).count() == 0


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[k][0], len(sets[k]), smallest[find(k)]) for k in range(len(rows))]


def test_components_match_brute_force(docs_of):
    random.seed(8)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [random.choices(vocabulary, k=random.choice([30, 80, 200])) for _ in range(6)]
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x  Y\tz"), (7, "X y z"), (7, "X y z")]
    for i in range(90):
        words = list(random.choice(bases))
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((200 - i, " ".join(words)))
    for percent in (90, 60):
        got = ngram_join.similar_documents(docs_of(rows), percent=percent).collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, 3, percent), key=key)
    assert ngram_join.similar_documents(docs_of([])).count() == 0


def test_a_pair_that_shares_many_shingles_gives_few_rows(docs_of, monkeypatch):
    random.seed(5)
    rows = []
    for cluster in range(3):
        text = [f"w{cluster}x{i}" for i in range(400)]
        for copy in range(4):
            changed_text = list(text)
            for _ in range(8):
                changed_text[random.randrange(400)] = f"n{random.randrange(10**9)}"
            rows.append((10 * cluster + copy, " ".join(changed_text)))
    made, often = [], ngram_join.often

    def counted(pairs, *rest):
        made.append((pairs.count(), pairs.select("a", "b").distinct().count()))
        return often(pairs, *rest)

    for earlier in (16, 2):  # all earlier groups named, and only some of them
        monkeypatch.setattr(ngram_join, "EARLIER", earlier, raising=False)
        monkeypatch.setattr(ngram_join, "often", counted)
        got = ngram_join.similar_documents(docs_of(rows)).collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(rows, 3, 90))
    assert 0 < made[1][1] <= made[1][0] <= 6 * made[1][1]
