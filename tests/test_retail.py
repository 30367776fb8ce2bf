import pytest
from pyspark.sql import functions as F

from tallyframe.plans import star
from tallyframe.plans.retail import retail_model
from tests import seed

MARCH, FEB, JAN = star.month("2026-03"), star.month("2026-02"), star.month("2026-01")


@pytest.fixture(scope="module")
def model(spark):
    return retail_model({n: t.cache() for n, t in seed.tables(spark).items()})


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name, options, expected", [
    ("net_sales", {"by": "customer", "period": MARCH, "top": 10},
     [("North District Market", 1000), ("Lakeside Wholesale", 800), ("Summit Grocers", 650), ("Metro Online Store", 500)]),
    ("quantity_sold", {"by": "product", "period": MARCH, "top": 10},
     [("Cold Brew Coffee 6 Pack", 20), ("Cane Sugar 2kg", 13), ("Trail Mix Pouch", 12), ("Sparkling Water 12 Pack", 10), ("Protein Bar Box", 5)]),
    ("document_count", {"by": "document_type", "period": MARCH}, [("Sales Invoice", 2), ("Online Order", 1), ("Store Receipt", 1)]),
    ("debit_amount", {"by": "ledger_account", "period": MARCH, "top": 10}, [("1100", "Accounts Receivable", 2450), ("4000", "Sales Revenue", 0)]),
    ("credit_amount", {"by": "ledger_account", "period": MARCH, "top": 10}, [("4000", "Sales Revenue", 2450), ("1100", "Accounts Receivable", 0)]),
    ("line_net_sales", {"by": "product", "period": MARCH, "top": 10},
     [("Cold Brew Coffee 6 Pack", 800), ("Cane Sugar 2kg", 650), ("Sparkling Water 12 Pack", 600), ("Trail Mix Pouch", 500), ("Protein Bar Box", 400)]),
    ("net_sales", {"by": "brand", "period": MARCH, "top": 10}, [("Northstar Goods", 1400), ("Sunvale Foods", 900), ("Riverbend Pantry", 650)]),
    ("net_sales", {"where": {"campaign": ["urban refresh"]}, "period": MARCH}, [(1400,)]),
    ("gross", {"by": "customer", "period": MARCH, "top": 10},
     [("North District Market", 1120), ("Lakeside Wholesale", 880), ("Summit Grocers", 700), ("Metro Online Store", 530)]),
    ("net_sales", {"by": "product_category", "period": MARCH}, [("Beverages", 1400), ("Snacks", 900), ("Pantry", 650)]),
    ("quantity_sold", {"by": "product_category", "period": MARCH, "top": 10}, [("Beverages", 30), ("Snacks", 17), ("Pantry", 13)]),
    ("net_sales", {"by": "customer", "order_by_name": True, "periods_as_columns": {"jan": JAN, "feb": FEB}},
     [("North District Market", 0, 700), ("Summit Grocers", 450, 0), ("Valley Corner Shop", 0, 300)]),
    ("outstanding", {"by": "customer"},
     [("Lakeside Wholesale", 900), ("North District Market", 250), ("Metro Online Store", 200), ("Summit Grocers", 0), ("Valley Corner Shop", 0)]),
    ("debit_credit", {"by": "ledger_account_or_none", "live_only": False},
     [("1100", "Accounts Receivable", 4050, 0), ("4000", "Sales Revenue", 0, 4050)]),
    ("document_count", {"by": "document_type"}, [("Sales Invoice", 5), ("Store Receipt", 2), ("Online Order", 1)]),
])
def test_metric(model, name, options, expected):
    assert got(star.metric(model, name, **options)) == expected


def test_outstanding_keeps_positive_balances_only(model):
    rows = got(star.metric(model, "outstanding", by="customer", row_filter=F.col("BalanceAmount") > 0))
    assert rows == [("Lakeside Wholesale", 900), ("North District Market", 250), ("Metro Online Store", 200)]


def test_products_sold_in_february_only(model):
    assert got(star.sold_not_in(model, FEB, MARCH)) == [(1,)]


def test_documents_without_postings(model):
    assert got(star.without_related(model, model.tables["AccountingPosting"])) == [(3,)]


def test_products_matching_terms(model):
    found = star.products_sold_matching(model, MARCH, {"ProductName": ["sparkling water"], "ProductTags": ["seltzer", "carbonated water"]})
    assert got(found) == [("Sparkling Water 12 Pack",)]


def test_posted_in_march(model):
    assert star.live_headers(model, MARCH, "PostingDate").count() == 4


def test_posting_without_account_keeps_its_row(spark, model):
    extra = model.tables["AccountingPosting"].limit(1).withColumn("LedgerAccountId", F.lit(99)).withColumn("DebitAmount", F.lit(5).cast("decimal(24,8)"))
    tables = dict(model.tables, AccountingPosting=model.tables["AccountingPosting"].unionByName(extra))
    rows = got(star.metric(retail_model(tables), "debit_credit", by="ledger_account_or_none", live_only=False))
    assert (None, None, 5.0, 0.0) in rows


def test_monthly_trend_of_named_products(model):
    rows = got(star.monthly_trend(model, "net_sales", terms=["SPARKLING"]))
    assert [(str(m), v) for m, v in rows] == [("2026-03-01", 600), ("2026-04-01", 900)]


def test_hot_customer_is_folded_before_the_join(model):
    plan = star.metric(model, "net_sales", by="customer")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")
