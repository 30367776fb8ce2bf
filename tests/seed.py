"""Rows of the small retail fixture."""

import datetime

from tallyframe.sources.retail_schema import schemas, with_defaults

D = datetime.date.fromisoformat


def rows():
    names = lambda table, key, column, values: [{key: i + 1, column: v} for i, v in enumerate(values)]
    documents = [
        (1, "2026-03-05", "2026-03-06", 1, 1, 2, 0, 1120, 1000, 250), (2, "2026-03-10", "2026-03-10", 2, 1, 2, 0, 880, 800, 0),
        (3, "2026-03-12", "2026-03-13", 3, 2, 3, 0, 530, 500, 200), (4, "2026-02-20", "2026-02-21", 1, 1, 3, 0, 760, 700, 0),
        (5, "2026-02-25", "2026-02-25", 4, 4, 1, 0, 330, 300, 0), (6, "2026-03-15", "2026-03-15", 4, 3, 1, 1, 220, 200, 200),
        (7, "2026-01-10", "2026-01-11", 5, 1, 1, 0, 490, 450, 0), (8, "2026-03-18", "2026-03-19", 5, 4, 3, 0, 700, 650, 0),
        (9, "2026-04-05", "2026-04-05", 2, 1, 2, 0, 980, 900, 900),
    ]
    lines = [(1, 1, 10, 600), (1, 2, 5, 400), (2, 3, 20, 800), (3, 4, 12, 500), (4, 5, 7, 700),
             (5, 2, 3, 300), (6, 6, 4, 200), (7, 6, 9, 450), (8, 7, 13, 650), (9, 1, 15, 900)]
    products = [
        ("Sparkling Water 12 Pack", "seltzer carbonated fizzy water", 1, 1, 2), ("Protein Bar Box", "energy bar meal bar", 2, 2, 1),
        ("Cold Brew Coffee 6 Pack", "iced coffee ready to drink coffee", 1, 1, 2), ("Trail Mix Pouch", "nuts dried fruit snack", 2, 2, 3),
        ("Long Grain Rice 5kg", "pantry rice staple", 3, 3, 3), ("Kitchen Towels 4 Roll", "household paper towels", 4, 4, 1),
        ("Cane Sugar 2kg", "pantry sugar baking", 3, 3, 3), ("Herbal Tea Variety Pack", "tea beverage", 1, 1, 1),
    ]
    postings = []
    for document, day, amount in ((1, "2026-03-06", 1000), (2, "2026-03-10", 800), (4, "2026-02-21", 700), (8, "2026-03-19", 650), (9, "2026-04-05", 900)):
        for account, debit, credit in ((2, amount, 0), (1, 0, amount)):
            postings.append({"AccountingPostingId": len(postings) + 1, "SalesDocumentId": document, "LedgerAccountId": account,
                             "PostingDate": D(day), "DebitAmount": debit, "CreditAmount": credit})
    return {
        "SalesDocument": [
            {"SalesDocumentId": i, "DocumentNo": f"D{i}", "DocumentDate": D(a), "PostingDate": D(b), "CustomerId": c, "DocumentTypeId": t,
             "CampaignId": g, "IsCanceled": x, "GrossAmount": gross, "NetAmount": net, "BalanceAmount": balance}
            for i, a, b, c, t, g, x, gross, net, balance in documents],
        "SalesDocumentLine": [
            {"SalesDocumentLineId": i + 1, "SalesDocumentId": s, "ProductId": p, "Quantity": q, "NetAmount": n} for i, (s, p, q, n) in enumerate(lines)],
        "AccountingPosting": postings,
        "Product": [
            {"ProductId": i + 1, "ProductCode": f"P{i + 1}", "ProductName": n, "ProductTags": t, "ProductCategoryId": c, "BrandId": b, "CampaignId": g}
            for i, (n, t, c, b, g) in enumerate(products)],
        "Customer": [
            {"CustomerId": i + 1, "CustomerName": n, "IsActive": int(i < 5)} for i, n in enumerate((
                "North District Market", "Lakeside Wholesale", "Metro Online Store", "Valley Corner Shop", "Summit Grocers", "Dormant Demo Account"))],
        "DocumentType": names("", "DocumentTypeId", "DocumentTypeName", ("Sales Invoice", "Online Order", "Credit Memo", "Store Receipt")),
        "LedgerAccount": [{"LedgerAccountId": 1, "AccountCode": "4000", "AccountName": "Sales Revenue"},
                          {"LedgerAccountId": 2, "AccountCode": "1100", "AccountName": "Accounts Receivable"}],
        "Brand": names("", "BrandId", "BrandName", ("Northstar Goods", "Sunvale Foods", "Riverbend Pantry", "Homebase Supply")),
        "ProductCategory": names("", "ProductCategoryId", "CategoryName", ("Beverages", "Snacks", "Pantry", "Household")),
        "Campaign": names("", "CampaignId", "CampaignName", ("First", "Urban Refresh", "Third")),
    }


def tables(spark):
    declared = schemas()
    made = {}
    for name, values in rows().items():
        columns = list(values[0])
        sub = type(declared[name])([f for f in declared[name].fields if f.name in columns])
        as_text = spark.createDataFrame(
            [tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in values], ", ".join(f"{c} string" for c in columns))
        made[name] = with_defaults(as_text, declared[name])
        assert sub
    return made
