"""The retail model: metrics, dimensions and routes over the thirteen tables, and
a second set of declarations for an orders/lineitem schema in the same roles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.numbers import exact
from tallyframe.plans.star import Dimension, Hop, Measure, Metric, StarModel

HEADER, LINE, POSTING = "SalesDocument", "SalesDocumentLine", "AccountingPosting"


def _header_sum(alias: str, column: str) -> Metric:
    return Metric(HEADER, (Measure(alias, column),))


METRICS = {
    "net_sales": _header_sum("total_net_amount", "NetAmount"),
    "line_net_sales": Metric(LINE, (Measure("total_net_amount", "NetAmount"),)),
    "quantity_sold": Metric(LINE, (Measure("total_qty", "Quantity", 3),)),
    "document_count": Metric(HEADER, (Measure("document_count"),)),
    "debit_amount": Metric(POSTING, (Measure("total_debit", "DebitAmount"),)),
    "credit_amount": Metric(POSTING, (Measure("total_credit", "CreditAmount"),)),
    "debit_credit": Metric(
        POSTING, (Measure("total_debit", "DebitAmount"), Measure("total_credit", "CreditAmount"))
    ),
    "outstanding": _header_sum("outstanding_balance", "BalanceAmount"),
    "paid": _header_sum("total_paid", "PaidAmount"),
    "gross": _header_sum("total_gross_amount", "GrossAmount"),
    "payable": _header_sum("total_payable", "NetPayableAmount"),
    "bill_total": _header_sum("total_bill", "BillTotalAmount"),
    "subtotal": _header_sum("total_subtotal", "SubtotalAmount"),
}

# With one of these in play a sales total is taken from the lines.
PRODUCT_DIMENSIONS = frozenset({"product", "brand", "product_category", "campaign"})

_TO_PRODUCT = Hop("ProductId", "Product", "ProductId")
_TO_HEADER = Hop("SalesDocumentId", HEADER, "SalesDocumentId")


def _of_header(hop: Hop) -> dict[str, tuple[Hop, ...]]:
    return {HEADER: (hop,), LINE: (_TO_HEADER, hop), POSTING: (_TO_HEADER, hop)}


def _of_product(*hops: Hop) -> dict[str, tuple[Hop, ...]]:
    return {LINE: (_TO_PRODUCT, *hops)}


DIMENSIONS = {
    "customer": Dimension(
        "CustomerId", ("CustomerName",), _of_header(Hop("CustomerId", "Customer", "CustomerId"))
    ),
    "store_location": Dimension(
        "StoreLocationId", ("LocationName",), _of_header(Hop("StoreLocationId", "StoreLocation", "StoreLocationId"))
    ),
    "document_type": Dimension(
        "DocumentTypeId", ("DocumentTypeName",), _of_header(Hop("DocumentTypeId", "DocumentType", "DocumentTypeId"))
    ),
    "product": Dimension(
        "ProductId", ("ProductName",), _of_product(), search=("ProductName", "ProductCode", "ProductTags")
    ),
    "brand": Dimension("BrandId", ("BrandName",), _of_product(Hop("BrandId", "Brand", "BrandId"))),
    "product_category": Dimension(
        "ProductCategoryId",
        ("CategoryName",),
        _of_product(Hop("ProductCategoryId", "ProductCategory", "ProductCategoryId")),
    ),
    "campaign": Dimension(
        "CampaignId", ("CampaignName",), _of_product(Hop("CampaignId", "Campaign", "CampaignId"))
    ),
    "ledger_account": Dimension(
        "LedgerAccountId",
        ("AccountCode", "AccountName"),
        {POSTING: (Hop("LedgerAccountId", "LedgerAccount", "LedgerAccountId"),)},
    ),
    "ledger_account_or_none": Dimension(
        "LedgerAccountId",
        ("AccountCode", "AccountName"),
        {POSTING: (Hop("LedgerAccountId", "LedgerAccount", "LedgerAccountId"),)},
        how="left",
    ),
}


def retail_model(tables: Mapping[str, DataFrame]) -> StarModel:
    """The model over tables named and shaped like the thirteen retail tables."""
    return StarModel(
        tables=tables,
        metrics=METRICS,
        dimensions=DIMENSIONS,
        grains={"net_sales": "line_net_sales"},
        line_dimensions=PRODUCT_DIMENSIONS,
    )


def _status_flag() -> Column:
    return F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)


def orders_as_retail(spark: SparkSession, folder: str) -> StarModel:
    """The same model over orders/lineitem parquet tables, column by column.

    The views are plain projections, so pruning and filters pass through to the scan.
    """
    read = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in
            ("orders", "lineitem", "customer", "part", "supplier", "nation", "region")}
    price = exact("l_extendedprice")
    net = price * (F.lit(1).cast("decimal(3,2)") - exact("l_discount", 4, 2))
    total = exact("o_totalprice")
    tables = {
        HEADER: read["orders"].select(
            F.col("o_orderkey").alias("SalesDocumentId"),
            F.col("o_orderdate").alias("DocumentDate"),
            # terms of 0 to 44 days and a fee by customer, so that no two dates or amounts are the same column
            (F.col("o_orderdate") + F.make_dt_interval(F.pmod("o_orderkey", F.lit(45)).cast("int"))).alias("DueDate"),
            F.col("o_custkey").alias("CustomerId"),
            F.col("o_orderpriority").alias("DocumentTypeId"),
            F.col("o_orderpriority").alias("DocumentTypeName"),
            _status_flag().alias("IsCanceled"),
            total.alias("NetAmount"),
            (total + F.pmod("o_custkey", F.lit(7)).cast("decimal(2,0)") * F.lit(1000).cast("decimal(4,0)")).alias("BillTotalAmount"),
            F.when(F.col("o_orderstatus") == "O", total).otherwise(0).alias("BalanceAmount"),
            F.when(F.col("o_orderstatus") == "F", total).otherwise(0).alias("PaidAmount"),
        ),
        LINE: read["lineitem"].select(
            F.col("l_orderkey").alias("SalesDocumentId"),
            F.col("l_partkey").alias("ProductId"),
            F.col("l_suppkey").alias("SupplierId"),
            F.col("l_shipdate").alias("PostingDate"),
            exact("l_quantity").alias("Quantity"),
            price.alias("GrossAmount"),
            net.alias("NetAmount"),
        ),
        POSTING: read["lineitem"].select(
            F.col("l_orderkey").alias("SalesDocumentId"),
            F.col("l_suppkey").alias("LedgerAccountId"),
            F.col("l_shipdate").alias("PostingDate"),
            F.when(F.col("l_linestatus") == "O", price).otherwise(0).alias("DebitAmount"),
            F.when(F.col("l_linestatus") == "F", price).otherwise(0).alias("CreditAmount"),
        ),
        "Customer": read["customer"].select(
            F.col("c_custkey").alias("CustomerId"),
            F.col("c_name").alias("CustomerName"),
            F.col("c_mktsegment").alias("CustomerSegment"),
            F.col("c_nationkey").alias("StoreLocationId"),
            exact("c_acctbal").alias("AccountBalance"),
        ),
        "Product": read["part"].select(
            F.col("p_partkey").alias("ProductId"),
            F.col("p_name").alias("ProductName"),
            F.col("p_brand").alias("BrandName"),
            F.col("p_type").alias("CategoryName"),
        ),
        "Supplier": read["supplier"].select(
            F.col("s_suppkey").alias("SupplierId"), F.col("s_nationkey").alias("NationId")
        ),
        "LedgerAccount": read["supplier"].select(
            F.col("s_suppkey").alias("LedgerAccountId"),
            F.col("s_suppkey").cast("string").alias("AccountCode"),
            F.col("s_name").alias("AccountName"),
        ),
        "Nation": read["nation"].select(
            F.col("n_nationkey").alias("NationId"),
            F.col("n_name").alias("LocationName"),
            F.col("n_regionkey").alias("RegionId"),
        ),
        "Region": read["region"].select(F.col("r_regionkey").alias("RegionId"), F.col("r_name").alias("CampaignName")),
    }
    to_customer = Hop("CustomerId", "Customer", "CustomerId")
    dimensions = {
        "customer": Dimension("CustomerId", ("CustomerName",), _of_header(to_customer)),
        "store_location": Dimension(
            "NationId",
            ("LocationName",),
            {HEADER: (to_customer, Hop("StoreLocationId", "Nation", "NationId"))},
        ),
        "product": Dimension("ProductId", ("ProductName",), _of_product(), search=("ProductName", "CategoryName")),
        "brand": Dimension("BrandName", ("BrandName",), _of_product()),
        "product_category": Dimension("CategoryName", ("CategoryName",), _of_product()),
        "campaign": Dimension(
            "RegionId",
            ("CampaignName",),
            {
                LINE: (
                    Hop("SupplierId", "Supplier", "SupplierId"),
                    Hop("NationId", "Nation", "NationId"),
                    Hop("RegionId", "Region", "RegionId"),
                )
            },
        ),
    }
    dimensions["document_type"] = Dimension(
        "DocumentTypeId", ("DocumentTypeName",), {HEADER: (), LINE: (_TO_HEADER,)}
    )
    dimensions["ledger_account"] = DIMENSIONS["ledger_account"]
    dimensions["ledger_account_or_none"] = DIMENSIONS["ledger_account_or_none"]
    metrics = dict(METRICS, gross=Metric(LINE, (Measure("total_gross_amount", "GrossAmount"),)))
    return StarModel(
        tables=tables,
        metrics=metrics,
        dimensions=dimensions,
        grains={"net_sales": "line_net_sales"},
        line_dimensions=PRODUCT_DIMENSIONS,
    )
