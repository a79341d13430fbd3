import random

from bidloom.llm import leaks

R = random.Random(9)
VOCAB = [f"w{i}" for i in range(60)]
ITEMS = [(i, " ".join(R.choice(VOCAB) for _ in range(40))) for i in range(12)] + [(50, "ngắn quá"), (51, "")]


def run(tests, words_a, words_b):
    best = 0
    where: dict = {}
    for i in range(len(words_a)):
        for j in range(len(words_b)):
            where[i, j] = where.get((i - 1, j - 1), 0) + 1 if words_a[i] == words_b[j] else 0
            best = max(best, where[i, j])
    return best


def test_against_brute_force(spark):
    docs = []
    for i in range(60):
        noise = [R.choice([*VOCAB, "lạ", "khác"]) for _ in range(R.randrange(5, 60))]
        w = ITEMS[i % 12][1].split()
        if i % 4 == 0:
            noise[3:3] = w[5 : 5 + 12 + i % 9]
        elif i % 4 == 1:
            noise[3:3] = w[5 : 5 + 8]
        elif i % 4 == 2:
            noise[3:3] = [x if k % 8 else "nearly" for k, x in enumerate(w)]
        docs.append((i, " ".join(noise).upper() if i % 3 else "<p>" + ", ".join(noise) + "</p>"))
    docs += [(100, None), (101, ""), (102, "..."), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = leaks.Index(ITEMS)
    got = {(r.doc_id, r.test_id): r for r in leaks.leaks(df, "doc_id", "text", index).collect()}
    for d, t in docs:
        for k, item in ITEMS:
            a, b = leaks.words_of(t), leaks.words_of(item)
            n = run(None, a, b)
            assert ((d, k) in got and got[d, k].longest == n) if n >= 12 else not ((d, k) in got and got[d, k].longest)
    assert all((i, i % 12) in got for i in range(2, 60, 4))
    assert sum(1 for r in leaks.leaks(df, "doc_id", "text", index).collect() if r.doc_id == 0) == 2 * sum(1 for d, _ in got if d == 0)
    kept = {r.doc_id for r in leaks.without_leaks(df, "doc_id", "text", index).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert leaks.leaks(df.limit(0), "doc_id", "text", index).count() == 0
    assert leaks.leaks(df, "doc_id", "text", leaks.Index([])).count() == 0


def test_words():
    assert leaks.words_of("Độ rung <b>65,07</b>&nbsp;- ĐIỆN trở") == ["do", "rung", "6507", "dien", "tro"]
    assert leaks.common([1, 2, 3, 4], [1, 9, 3, 4]) == 3 and leaks.common([], [1]) == 0


def test_damaged_copies_against_brute_force(spark):
    """Items of 1 to 40 words, copies with words lost, changed and put in; every passage is tried in the brute-force version."""
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(r.choices(vocab, k=n))) for i, n in enumerate([1, 2, 4, 5, 5, 7, 10, 11, 20, 40])]
    docs = [(900, "x alpha beta zzz delta epsilon y"), (901, "<p " + "a" * 900 + ">v1</p>")]
    for d in range(150):
        ws = []
        for w in items[d % 10][1].split():
            if r.random() > 0.12:
                ws.append(w if r.random() > 0.1 else "other")
            if r.random() < 0.15:
                ws.append(r.choice([*vocab, "noise"]))
        docs.append((d, " ".join(r.choices([*vocab, "lạ"], k=r.randrange(8)) + ws + r.choices(vocab, k=r.randrange(8)))))
    items.append((77, "alpha beta gamma delta epsilon"))
    index = leaks.Index(items)
    got = {(x.doc_id, x.test_id): x.share for x in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", index).collect()}
    told = {}
    for d, t in docs:
        a = leaks.words_of(t)
        for k, item in items:
            b = leaks.words_of(item)
            n = len(b)
            best = max((leaks.common(b, a[i : i + int(n * leaks.STRETCH)]) for i in range(len(a))), default=0)
            if best >= -(-n * leaks.SHARE // 1) or n >= 12 and run(None, a, b) >= 12:
                told[d, k] = best / n
    assert set(got) == set(told) and (900, 77) in got and len(told) > 100
