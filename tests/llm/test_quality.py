import numpy as np

from kinfold.llm import quality as S


def test_statistics_of_odd_texts():
    for text in (None, "", "   \n", "x", "\n\nword", "é" * 100_000, "a b " * 50_000, "🙂 🙂", " ", " . "):
        got = S.statistics(text)
        assert len(got) == len(S.FEATURES) and np.isfinite(got).all()


def walk(model, row):
    total = model.base
    for k in model.roots:
        while model.left[k] != k:
            k = model.left[k] if row[model.feature[k]] <= model.split[k] else model.right[k]
        total += model.value[k]
    return 1 / (1 + np.exp(-total))


def test_flat_arrays_score_as_a_walk_down_the_trees():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = S.BoostedTrees().fit(x, y)
    got = model.score(x)
    assert np.allclose(got, [walk(model, r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95


def test_one_class_or_none_is_constant():
    assert S.BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    got = S.BoostedTrees().fit(np.zeros((8, 3)), np.ones(8)).score(np.ones((1, 3)))
    assert np.isclose(got[0], 0.9)


def test_query_on_odd_rows(spark):
    docs = spark.createDataFrame([(k, ("good words here. " if k % 2 else "## !! ## ") * 20, "x", 1.0) for k in range(200)] + [(None, None, "x", 1.0), (900, "", "x", 1.0), (1, "good words here. " * 20, "x", 1.0)], "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(150)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = S.score_quality(docs, labels).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    assert S.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in S.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in S.score_quality(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = S.score_quality(d, labels).where("held_out").join(labels, "doc_id")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()


def test_statistics_by_definition():
    """Each statistic counted word by word and character by character."""
    text = "The end. The end | of 12 days!\n\nÉté is here; here (42) is\tUP\nThe end."
    words, data = text.split(), text.encode()
    n, size = len(words), len(data)
    share = lambda chars: sum(b in chars for b in data) / size
    letters = [b for b in range(256) if b >= 128 or chr(b).isalpha() and b < 128]
    pairs = [(a, b) for a, b in zip(words, words[1:], strict=False)]
    longest, run = 1, 1
    for a, b in pairs:
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    lines = [x for x in text.split("\n") if x.strip()]
    p = [data.count(bytes([b])) / size for b in set(data)]
    want = {
        "log_bytes": np.log(1 + size), "log_words": np.log(1 + n), "word_length": mean, "word_length_spread": (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5, "distinct_words": len(set(words)) / n,
        "repeated_next": sum(a == b for a, b in pairs) / (n - 1), "longest_run": np.log(longest), "top_word": max(words.count(w) for w in words) / n, "top_pair": max(pairs.count(x) for x in pairs) / (n - 1), "distinct_pairs": len(set(pairs)) / (n - 1),
        "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "letters": share(letters), "digits": share(b"0123456789"), "stops": share(b"."), "pipes": share(b"|"), "spaces": share(b" \t\n\r\v\f"), "high_bytes": share(range(128, 256)),
        "entropy": -sum(x * np.log2(x) for x in p), "capital_words": sum(w[0].isupper() for w in words) / n, "wordless": sum(not any(c.isalpha() for c in w) for w in words) / n, "log_lines": np.log(1 + len(lines)), "line_words": n / len(lines),
        "distinct_lines": len(set(lines)) / len(lines), "lines_ended": sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), "stops_per_word": sum(w[-1] in ".!?" for w in words) / n, "short_words": sum(x <= 3 for x in lengths) / n,
    }
    got = dict(zip(S.FEATURES, S.statistics(text), strict=True))
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) >= 1e-9}


def test_the_first_split_is_the_best_of_all():
    """The first tree's root against every split of every feature, tried one after another."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (200, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (rng.random(200) < 0.1)).astype(float)
    model = S.BoostedTrees().fit(x, y)
    p = (y.sum() + 1) / (len(y) + 2)
    grad, hess = p - y, np.full(len(y), p * (1 - p))
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < S.LEAST_LEAF:
                continue
            gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + S.L2) for m in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + S.L2)
            if gain > best[0]:
                best = (gain, j, left)
    root = model.roots[0]
    assert model.feature[root] == best[1] and ((x[:, best[1]] <= model.split[root]) == best[2]).all()


def test_one_text_of_a_repeated_id_is_learned_from(spark):
    docs = [(1, "b b b"), (1, "a a a a"), (1, "c"), (2, "x y z"), (None, "n")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    models = [S.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (docs, docs[::-1])]
    assert models[0].base == models[1].base
