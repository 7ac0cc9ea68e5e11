from rulemeter.llm import decontaminate


def test_items_without_a_window_are_found_word_for_word(spark, docs):
    sums = "What is 12 + 30 - 4 * 5 / 2 + 7 - 9 ?"
    names = "Did Anna Berta Clara Doris Emma Frida Gerda Hanna Ida Jutta Karla and Lena meet"
    items = spark.createDataFrame([(1, "What is the capital of Australia?"), (2, sums), (3, names), (4, ""), (5, None)], "item_id long, text string")
    rows = [
        (1, "So the teacher asked: what is the capital of Australia, and nobody knew", "s"),
        (2, f"A page of sums. {sums} And so on for a while", "s"),
        (3, f"{names} at last", "s"),
        (4, "What is the capital of Austria? " + sums.replace("30", "31"), "s"),
        (5, names.replace("Karla", "Maria"), "s"),
        (6, "Hanna Ida Jutta Karla and Lena meet. " + " ".join(names.split()[:9]), "s"),
        (7, None, "s"),
    ]
    got = {(r.doc_id, r.item_id, r.n_windows, r.item_windows, r.coverage, r.slot_agreement) for r in decontaminate.leaks(docs(rows), items).collect()}
    assert got == {(d, i, 1, 1, 1.0, 1.0) for d, i in ((1, 1), (2, 2), (3, 3))}
    assert sorted(r.doc_id for r in decontaminate.clean(docs(rows), items).collect()) == [4, 5, 6, 7]
