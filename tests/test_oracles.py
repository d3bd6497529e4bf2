import pytest
from compare import connection, difference

from orefield import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


#: Whether the queries that have run here gave no rows.
EMPTY_HERE: dict[str, bool] = {}


class Collected:
    """A query's result that notes whether it has rows, so that no test needs to run the query again to know."""

    def __init__(self, name, df):
        self.name, self.df, self.columns = name, df, df.columns

    def collect(self):
        rows = self.df.collect()
        EMPTY_HERE[self.name] = not rows
        return rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_sql_gives(spark, con, name):
    assert difference(spark, SF, lambda s, d: Collected(name, registry.queries()[name](s, d)), registry.oracle_sql()[name], con) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    EMPTY_HERE[name] = not df.count()


#: Queries of round 1 that ask for what these tables lack; facets_of_state, recommend_profile, search_identifier and facts_in_sentences ask for what they have.
#: The last two have rows from the next scale on.
EMPTY = {"recommend_anti", "exact_ids", "facts_in_turns", "filter_params", "semi_join_brands"}


def test_every_query_gives_rows(spark):
    assert {n for n, f in registry.queries().items() if (EMPTY_HERE[n] if n in EMPTY_HERE else f(spark, SF).isEmpty())} <= EMPTY


def test_every_branch_gives_rows(spark):
    made = registry.queries()
    values = lambda name, column: {r[0] for r in made[name](spark, SF).select(column).distinct().collect()}
    facets = made["facets_of_state"](spark, SF.replace("sf0.001", "sf0.01"))  # the smallest scale has two of the five
    assert {r[0] for r in facets.select("facet").distinct().collect()} == {"state", "sector", "category", "source", "value"}
    assert values("money_texts", "error") == {None, "not a money amount"}
    assert values("facts_in_sentences", "kind") == {"date", "money", "percent", "number"}
    assert values("eligibility_verdicts", "verdict") == {"eligible", "not_eligible", "unknown"}
    for name, column in (("grounded_answers", "ok"), ("rank_errors", "refused"), ("kept_pages", "discarded")):
        assert values(name, column) == {True, False}
    assert len(values("sector_cascade", "sector")) > 8


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
