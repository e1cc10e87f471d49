from keystrata.llm import decontamination as d

ITEM = "A train leaves Paris at 9 and travels 120 km towards Lyon while another train leaves Lyon at 10 and moves towards Paris. How far apart?"
SWAP = ITEM.replace("Paris", "Berlin").replace("Lyon", "Bonn").replace("120", "75").replace("km", "miles")
BROKEN = ITEM.replace("Paris", "Berlin", 1).replace("Lyon", "Rome", 1)
PROSE = "nothing of the sort happens in this quiet text about gardens and rivers that flow past mossy banks all summer long"


def flags(spark, rows, items):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in d.contamination(docs, bench).collect()}, docs, bench


def test_exact_swapped_and_clean(spark):
    rows = [(1, PROSE + " " + ITEM + " " + PROSE), (2, PROSE + " so: " + SWAP), (3, PROSE), (4, None), (5, ""), (6, BROKEN), (7, "12 34 56 78 " * 40), (8, (PROSE + " ") * 900 + ITEM), (9, " ".join(ITEM.split()[:9]))]
    got, docs, bench = flags(spark, rows, [(7, ITEM), (7, ITEM), (8, None), (9, ""), (10, "tiny item"), (11, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")])
    assert {k for k, v in got.items() if v[0]} == {1, 2, 8}
    assert got[1] == (True, 1, [7]) and got[3] == (False, 0, [])
    kept = d.clean_documents(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9] and kept.columns == docs.columns


def test_empty_tables(spark):
    assert flags(spark, [], [(1, ITEM)])[0] == {}
    assert flags(spark, [(1, ITEM)], [])[0] == {1: (False, 0, [])}


def test_word_codes():
    assert d.word_code("1,200.50") & d.NUM and d.word_code("$30") & d.NUM and d.word_code("km.") & d.UNIT and d.word_code("km.") & d.ENDS
    assert d.word_code("***") == 0 and d.word_code("the&&&") == d.word_code("the")


def test_every_whole_item_in_the_tables_is_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    assert want and want <= got
    words = {i: t.split() for i, t in items.items()}
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    assert all(any(" ".join(words[i][k : k + 8]) in texts[doc] for k in range(len(words[i]) - 7)) for doc, i in got)


def test_names_at_sentence_starts(spark):
    item = "Tom bought 12 pencils for 3 dollars. Anna bought 7 pencils for 2 dollars. How many pencils did Tom buy?"
    swap = item.replace("Tom", "Kim").replace("Anna", "Lea")
    rows = [(1, PROSE + ". " + swap), (2, swap.replace("12", "5").replace("7", "5")), (3, PROSE)]
    assert {k for k, v in flags(spark, rows, [(1, item)])[0].items() if v[0]} == {1, 2}


def test_two_values_may_become_one_and_long_parts_count(spark):
    long = ITEM + " " + ITEM.replace("Paris", "Oslo").replace("Lyon", "Rome").replace("120", "300")
    one = ITEM.replace("9", "8").replace("10", "8")
    other = long.replace("Paris", "Bonn").replace("towards Rome while", "towards Kiel while")
    got = flags(spark, [(1, one), (2, other), (3, ITEM.replace("another", "every other"))], [(1, ITEM), (2, long)])[0]
    assert got[1][2] == [1, 2] and 2 in got[2][2]


def test_runs_bridge_unmatched_tokens():
    literal = lambda p, named=0: (p, named, [""] * 8, [""] * 8)
    assert d.placement_tokens([literal(0), literal(9)], 40) == 16
    assert d.placement_tokens([literal(0), literal(11)], 40) == 0
    pair = lambda p, a, b: (p, 0, [a] + [""] * 7, [b] + [""] * 7)
    assert d.placement_tokens([pair(0, "x", "y"), pair(8, "x", "z")], 40) == 0
    assert d.placement_tokens([pair(8 * i, "x", "y" if i else "z") for i in range(6)], 60) == 47


def test_names_do_not_depend_on_their_place(spark):
    item = "Alice has three apples and gives two of them to her brother."
    docs = [(1, "Here it is. " + item), (2, "so " + item), (3, PROSE + " so Bob" + item[5:]), (4, "Then Mary Jane Smith" + item[5:]), (5, "Bob has three apples.")]
    assert {k for k, v in flags(spark, docs, [(1, item)])[0].items() if v[0]} == {1, 2, 3, 4}


def test_short_and_numeric_items(spark):
    items = [(1, "What is 12 times 15 plus 7 ?"), (2, "Add 12, 15, 17, 20, 22, 31, 44, 58, 61, 70 and 81 now."), (3, "Yes it is"), (4, "7 8 9 10 11 12")]
    docs = [(1, PROSE + " What is 12 times 15 plus 7? " + PROSE), (2, PROSE + " what is 3 times 4 plus 9"), (3, PROSE + " what is 3 times 4 minus 9"), (4, PROSE + " " + items[1][1]), (5, "yes it is"), (6, PROSE + " yes it is " + PROSE)]
    docs += [(7, "1 7 8 9 10 11 12 13"), (8, "7 8 9 10 11 13")]
    got = flags(spark, docs, items)[0]
    assert {k: v[2] for k, v in got.items() if v[0]} == {1: [1], 2: [1], 4: [2], 5: [3], 7: [4]}


def test_null_and_repeated_ids_are_judged_by_their_own_text(spark):
    rows = [(None, ITEM), (None, PROSE), (1, ITEM), (1, PROSE), (1, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (7, SWAP), (None, ITEM)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.contaminated) for r in d.contamination(docs, bench).collect())
    assert got == [("1", False), ("1", True), ("1", True), ("None", False), ("None", True)]
    assert sorted(map(str, (r.doc_id for r in d.clean_documents(docs, bench).collect()))) == ["1", "None"]


def test_exchanged_items_of_the_tables_are_found(spark):
    """Every item with its names (words that begin a sentence) and a number changed, put in the middle of a document."""
    import random

    rng = random.Random(4)
    sf = "/root/testdata/sf0.01"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = ["Alva", "Birk", "Cleo", "Dara"]
    rows = []
    for (i, t), around in zip(items, texts, strict=True):
        begins, name = [w for k, w in enumerate(t.split()) if k == 0 or t.split()[k - 1][-1] in ".!?"], {}
        for w in begins:
            name.setdefault(w, names[len(name) % 4] + str.lower("x" * (len(name) // 4)))
        swapped = " ".join(name.get(w, w) for w in t.split())
        words = around.split()
        cut = rng.randrange(len(words) + 1)
        rows.append((i, " ".join(words[:cut]) + ". " + swapped + " " + " ".join(words[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    assert sum((i, i) in found for i, _ in items) == len(items)
