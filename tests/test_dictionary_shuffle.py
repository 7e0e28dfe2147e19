"""N-grams that are no entry of the dictionary are not shuffled."""

from evgraph.operators import extract as X


def test_only_hits_move(spark):
    docs = spark.createDataFrame([(k, "The blue anvil and the Red Anvil of rivet " * 3) for k in range(20)], "id long, text string")
    names = spark.createDataFrame([("red anvil",), ("the",)], "name string")
    found = X.dictionary_matches(docs, names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    semi, grouped = plan.index("LeftSemi"), plan.index("Aggregate")
    assert grouped < semi and "strategy=broadcast" in plan.replace("rightHint=(", "").replace(" ", "")[:100000].lower()
    assert sorted(map(tuple, found.where("id = 3").collect())) == [(3, "red anvil", 5, "Red Anvil"), (3, "the", 0, "The")]
