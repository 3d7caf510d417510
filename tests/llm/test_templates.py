"""Items that repeat a pattern, and copies in other case and spacing."""

from farfield.llm import decontamination
from tests.llm import cases
from tests.llm.test_groups import ITEM, PLAIN, items

APPLES = "How many apples are there if Tom has 5 apples and Ann has 7 apples and Joe has 9 apples in the basket today?"
BALLS = "The bag holds 3 red balls and 5 blue balls and the box holds 7 red balls and 9 blue balls and 2 more."


def found(spark, texts, rows):
    got = decontamination.leaks(cases.documents(spark, texts), items(spark, rows)).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in got)


def test_items_that_repeat_a_pattern(spark):
    lead = "some unrelated words stand here before it. "
    other = APPLES.replace("Tom", "Kim").replace("Ann", "Lea").replace("Joe", "Max").replace("5", "11").replace("7", "4")
    once = lead + "How many apples are there if Tom has 5 apples and Ann sleeps in the garden all day."
    shifted = APPLES.replace("Ann has", "also Ann has")
    texts = [(1, APPLES), (2, lead + BALLS), (3, lead + other), (4, once), (5, lead + APPLES + " " + APPLES), (6, lead + shifted)]
    assert found(spark, texts, [(1, APPLES), (2, BALLS)]) == [(1, 1), (2, 2), (3, 1), (5, 1), (6, 1)]
    repeated = "Tom has 5 apples and Ann has 7 apples and Joe has 9 apples and Eve has 8 apples and Bob has 6 apples and"
    assert found(spark, [(1, "Today Tom has 5 apples and sleeps."), (2, "Today " + repeated)], [(1, "Today " + repeated)]) == [(2, 1)]


def test_copies_in_other_case_and_spacing(spark):
    texts = []
    for k, item in enumerate((ITEM, PLAIN, APPLES)):
        wrapped, wide = "\n".join(item.split()), "  ".join(item.split())
        texts += [(10 * k + n, t) for n, t in enumerate((item.lower(), item.upper(), item.title(), wrapped, wide, "# ".join(item.split())))]
    rows = [(1, ITEM), (2, PLAIN), (3, APPLES)]
    assert found(spark, texts, rows) == [(10 * k + n, k + 1) for k in range(3) for n in range(6)]
    # and items in other case of texts as they are
    assert found(spark, [(1, "Lead. " + ITEM)], [(1, ITEM.upper()), (2, ITEM.lower())]) == [(1, 1), (1, 2)]
