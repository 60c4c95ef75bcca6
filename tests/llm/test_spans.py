from kinfold.llm import spans as S

SCHEMA = "doc_id long, text string, n_chars long, h1 string, runs string, pos int, row string, none int, id string, th long, kept string, removed int, changed string"
P = "Seven quick foxes ran over the wide green hill. They met a heron by the old mill. Nobody else came by that day."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, len(t) if t else None, "x", "y", 1, "r", 2, "i", 3, "k", 4, "c") for i, t in rows], SCHEMA)


def by_brute_force(rows):
    """What is left of each row's text and how many sentences went, by comparing all runs of all documents in order of id."""
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        text = rows[k][1]
        starts, ends = S.sentences(text) if text else ([], [])
        said = [" ".join(text[s:e].lower().split()) for s, e in zip(starts, ends, strict=True)]
        gone = set()
        for i in range(len(said) - S.RUN + 1):
            if seen.setdefault(tuple(said[i : i + S.RUN]), (k, i)) != (k, i):
                gone |= set(range(i, i + S.RUN))
        left = "".join(text[s : (*starts, len(text))[j + 1]] for j, s in enumerate(starts) if j not in gone) if text else text
        out[k] = ((text[: starts[0]] + left).rstrip() if gone else text, len(gone))
    return out


def test_sentences_cover_text():
    for text in ("", "one", "A b. C d! E?", "x\n\ny\n", "left over Capital starts none. ends"):
        starts, ends = S.sentences(text)
        assert "".join(text[s:e] for s, e in zip(starts, ends, strict=True)).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert [("A b. c".replace("c", "C"))[s:e] for s, e in zip(*S.sentences("A b. C"), strict=True)] == ["A b.", "C"]


def test_only_real_ends_end_a_sentence():
    text = "they saw the Chair of the old board of the National Trust of the Irish Republic in Dublin again."
    assert S.sentences(text) == ([0], [len(text)]) and len(S.run_hashes(text)[0]) == 0


def test_runs_hold_three_sentences_however_short():
    h1, h2, start, until = S.run_hashes("Hi. Yo. Oh. Hi. Yo. Oh.")
    assert start.tolist() == [0, 4, 8, 12] and until.tolist() == [12, 16, 20, 23]
    assert (h1[0], h2[0]) == (h1[3], h2[3]) and len({*zip(h1.tolist(), h2.tolist(), strict=True)}) == 3


def test_matches_brute_force(spark):
    long = " ".join(f"unbroken{k}" for k in range(60))
    rows = [
        (1, f"Intro to it all. {P} Then an end of its own."), (2, f"Another start goes here and ends. {P} tail words."), (3, P), (4, "No repeats are in this one. It says its own things. And it stops at once here."), (5, None), (6, ""), (7, f"{P} {P}"),
        (8, "a " + long), (9, long + "\nnext line"), (10, long), (11, P.upper()), (12, "Hi. Yo. Oh. Hi. Yo. Oh."), (13, f"\n  Lead 𝔘. {P} \n"), (14, f"glued {P} One more sentence here."), (15, "Hi. Yo. Oh. " * 40),
        (16, "they saw the Chair of the old board of the National Trust of the Irish Republic in Dublin again."), (17, "we met the Chair of the old board of the National Trust of the Irish Republic in Dublin today."),
    ]
    got = {r.doc_id: r for r in S.remove_repeats(docs(spark, rows)).collect()}
    want = by_brute_force(rows)
    for k, (i, text) in enumerate(rows):
        assert (got[i].kept_text, got[i].sentences_removed) == want[k], i
        assert got[i].changed is (want[k][1] > 0), i
    assert got[3].kept_text == "" and got[5].kept_text is None and got[16].kept_text == rows[15][1]
    assert "heron" in got[1].kept_text and "heron" not in got[2].kept_text and "tail words." in got[2].kept_text and got[13].kept_text == "\n  Lead 𝔘."


def test_rows_that_repeat(spark):
    same = docs(spark, [(1, P), (1, P), (None, P), (None, P), (1, P + " More."), (0, "")])
    got = sorted(((r.doc_id, r.kept_text) for r in S.remove_repeats(same).collect()), key=str)
    kept = [t for _, t in got if t]
    assert len(got) == 6 and sorted(kept) in ([P, P, "More."], ["More.", P, P], [P + " More."]) and (None, "") in got


def test_stage_keeps_columns_and_clean_rows(spark):
    rows = [(1, P), (2, P), (3, f"Own words first of all. {P}"), (4, ""), (5, None)]
    out = S.drop_repeats(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    got = {r.doc_id: r for r in out.collect()}
    assert {k: (r.text, r.n_chars) for k, r in got.items()} == {1: (P, len(P)), 3: ("Own words first of all.", 23), 4: ("", None), 5: (None, None)}
    assert all(tuple(r)[3:] == ("x", "y", 1, "r", 2, "i", 3, "k", 4, "c") for r in got.values())
    assert S.drop_repeats(docs(spark, [])).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"Sentence number {k} is here." for k in range(30_000))
    got = {r.doc_id: (r.sentences_removed, r.kept_text) for r in S.remove_repeats(docs(spark, [(1, text), (2, text), (3, "Own. " + text + " End.")])).collect()}
    assert got[1][0] == 0 and got[2] == (30_000, "") and got[3] == (30_000, "Own. End.")


def test_passages_in_other_scripts_and_short_sentences(spark):
    title = " ".join(f"Word{k} And{k} More{k} Said{k}." for k in range(20))
    passages = [
        title, title.upper(), "\n".join(f"第{chr(0x4E00 + 7 * k)}行的內容是{chr(0x5000 + 11 * k)}" for k in range(40)), "".join(f"这是第{chr(0x4E00 + 5 * k)}个句子。" for k in range(12)),
        " ".join(f"Step{k} begins." for k in range(24)), "Every long sentence of this passage has more than eight words. Yes. No. Well.", "ประโยคแรกของข้อความนี้ ประโยคที่สองของข้อความ ประโยคที่สามของข้อความ",
    ]
    for passage in passages:
        rows = [(1, f"First of all, our own words.\n{passage}\nand so it ends."), (2, f"Here is another start.\n{passage}\nthen something else.")]
        got = {r.doc_id: r.kept_text for r in S.remove_repeats(docs(spark, rows)).collect()}
        assert got == {1: rows[0][1], 2: "Here is another start.\nthen something else."}


def test_a_run_that_very_many_documents_share(spark):
    rows = [(k, f"Own words of number {k} come first. {P}") for k in range(500)]
    got = {r.doc_id: r.kept_text for r in S.remove_repeats(docs(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {k: f"Own words of number {k} come first." for k in range(1, 500)}


def test_the_callers_batches_are_left_alone(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    S.remove_repeats(docs(spark, [(1, P)])).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_passage_inside_sentences_with_fewer_whole_ones_than_a_run(spark):
    passage = " ".join(f"{'Pasted' if k == 0 else 'word'}{k}{'.' if k in (19, 33) else ''}" for k in range(60))
    one = " ".join(f"alone{k}" for k in range(60))
    rows = [(1, f"first of all we {passage} then say more. {one}"), (2, f"İ and others {passage.upper()} go on here. so {one} too"), (3, "Nothing of it is in here. " * 2 + "And so it ends.")]
    got = {r.doc_id: r for r in S.remove_repeats(docs(spark, rows)).collect()}
    assert got[1].kept_text == rows[0][1] and got[3].kept_text == rows[2][1] and not got[1].changed
    left = got[2].kept_text
    assert got[2].changed and 1 <= got[2].sentences_removed <= 3 and sum(w.startswith(("PASTED", "WORD")) for w in left.split()) <= 2 * S.REACH
    assert left.startswith("İ and others ") and left.endswith(f"go on here. so {one} too")


def test_spans_follow_from_their_words_alone():
    passage = " ".join(f"w{k * k % 101}{'.' if k == 25 else ''}" for k in range(S.SPAN + S.REACH - 1))
    found = [{*zip(*(x.tolist() for x in S.span_hashes(f"{a} {passage} {b}")[:2]), strict=True)} for a, b in (("x", "y"), ("some other words before it", "and İ after"), ("a. " * 9, "b. " * 9))]
    assert found[0] & found[1] and found[0] & found[2] and S.span_hashes("")[0].size == S.span_hashes(None)[0].size == 0
