"""Word lists that the rules depend on."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Concepts of business tables and the column names that stand for them.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "sales": ("sales", "revenue", "turnover", "gross_sales", "net_sales", "amount",
              "sales_amount", "total_sales", "income", "earnings"),
    "profit": ("profit", "net_profit", "gross_profit", "earnings", "net_income", "margin", "gain",
               "operating_profit"),
    "profit_margin": ("profit_margin", "margin", "net_margin", "operating_margin", "gross_margin",
                      "margin_percentage"),
    "salary": ("salary", "compensation", "wage", "wages", "pay", "stipend", "remuneration",
               "base_pay", "total_compensation"),
    "quantity": ("quantity", "qty", "volume", "units", "units_sold", "count", "items",
                 "number_of_items"),
    "cost": ("cost", "expense", "expenses", "unit_cost", "total_cost", "shipping_cost", "cogs",
             "expenditure", "spend", "spending"),
    "price": ("price", "unit_price", "rate", "cost_per_unit", "mrp", "selling_price"),
    "discount": ("discount", "rebate", "deduction", "discount_amount", "discount_percent",
                 "discount_rate"),
    "target": ("target", "target_sales", "target_profit", "goal", "budget", "quota", "forecast",
               "projected"),
    "delivery": ("delivery_days", "delivery_time", "lead_time", "shipping_time", "transit_time",
                 "days_to_deliver"),
    "rating": ("rating", "score", "review_score", "satisfaction_score", "feedback_score"),
    "date": ("date", "order_date", "transaction_date", "created_at", "timestamp", "invoice_date",
             "day", "time"),
    "product": ("product", "item", "sku", "article", "merchandise", "good"),
    "category": ("category", "segment", "type", "class", "group", "genre", "family"),
    "region": ("region", "area", "zone", "territory", "location", "district", "sector"),
    "customer": ("customer", "client", "buyer", "shopper", "consumer", "patron", "user", "account"),
    "employee": ("employee", "staff", "worker", "personnel", "team_member"),
    "department": ("department", "dept", "division", "team", "unit", "branch"),
    "city": ("city", "town", "municipality", "metro"),
    "country": ("country", "nation", "state", "province"),
    "brand": ("brand", "manufacturer", "make", "vendor"),
    "channel": ("channel", "sales_channel", "distribution_channel", "platform"),
    "marketing": ("marketing_spend", "ad_spend", "advertising", "marketing_cost"),
    "stock": ("stock", "stock_level", "inventory", "inventory_level", "available_stock",
              "quantity_on_hand"),
    "experience": ("experience", "experience_years", "tenure", "years_of_experience"),
    "return": ("is_returned", "returned", "return_date", "returns", "return_rate"),
    "status": ("status", "state", "condition", "stage"),
}

# Header words that point to a business domain.
DOMAIN_WORDS: dict[str, tuple[str, ...]] = {
    "Sales / Retail": ("sales", "revenue", "profit", "discount", "quantity", "unit_price", "store",
                       "product", "region", "category", "transaction", "invoice"),
    "Employee / HR": ("salary", "employee", "department", "job_role", "attrition", "joining_date",
                      "experience", "performance_rating", "compensation", "bonus", "incentive"),
    "Customer / E-Commerce": ("customer", "order", "lifetime_value", "clv", "churn", "spending",
                              "average_order_value", "payment_method", "delivery_status", "cart"),
    "Finance": ("budget", "actual_spend", "expense", "income", "cost_center", "revenue", "loss",
                "financial_year", "account", "forecast"),
    "Marketing": ("campaign", "lead", "ctr", "cpc", "cpm", "impressions", "clicks", "conversions",
                  "reach", "ad_spend", "roi"),
    "Inventory / Supply Chain": ("stock", "warehouse", "sku", "supplier", "reorder_level",
                                 "safety_stock", "shipment", "delivery_time", "unit_cost",
                                 "inventory_value"),
    "Healthcare": ("patient", "doctor", "hospital", "disease", "diagnosis", "treatment_cost",
                   "admission", "discharge", "length_of_stay", "insurance"),
    "Student / Education": ("student", "marks", "score", "gpa", "cgpa", "attendance", "course",
                            "subject", "grade", "semester", "roll_number"),
}

# Column roles.
IDENTIFIER_NAMES = (
    "id", "code", "key", "pk", "uuid", "guid", "sku", "ssn", "hash", "ticket", "customerid",
    "orderid", "employeeid", "studentid", "transactionid", "recordid", "rowid", "userid",
    "accountid", "productid", "invoiceid",
)
IDENTIFIER_ENDINGS = (
    "id", "code", "no", "num", "number", "key", "pk", "uuid", "hash", "ticket", "invoice", "sku",
    "policy", "ssn", "roll", "guid",
)
UNIQUE_HINTS = ("id", "num", "code", "key", "roll", "ref", "index")
DATE_HINTS = ("date", "time", "year", "month", "day", "created", "updated", "joined", "shipped",
              "timestamp")
TARGET_HINTS = ("target", "goal", "budget", "quota", "forecast", "projected")
RATE_HINTS = ("margin", "rate", "ratio", "percent", "pct")
NON_NEGATIVE_HINTS = ("sales", "revenue", "price", "cost", "age", "quantity", "salary", "marks",
                      "count")
ZERO_FILL_HINTS = ("discount", "tax", "bonus", "qty", "quantity", "fee", "charge", "return",
                   "cancel")

# Question log.
QUESTION_OPERATIONS: dict[str, tuple[str, ...]] = {
    "sum": ("total", "sum", "overall", "combined", "add"),
    "mean": ("average", "avg", "mean"),
    "min": ("minimum", "min", "lowest", "smallest", "worst"),
    "max": ("maximum", "max", "highest", "largest", "top", "best"),
    "count": ("count", "number of", "how many", "total records"),
    "median": ("median", "middle"),
}
KPI_PHRASES = (
    "which kpi", "what kpi", "critical kpi", "at risk kpi", "kpi status", "active kpi",
    "target status", "alert history", "recent alert", "why is", "behind target",
    "exceeded target", "kpis are", "kpi monitoring",
)
KPI_WORDS = ("kpi", "target", "alert", "risk", "critical", "monitor")
FOLLOW_UP_WORDS = ("its", "it", "that", "this")
PER_GROUP_PHRASES = ("in each", "inside each", "within each", "per each", "for each")
ABSENT_CONCEPTS = ("churn", "retention", "nps", "bounce", "tax", "dividend", "depreciation")
# ----------------------------------------------------------------------------
