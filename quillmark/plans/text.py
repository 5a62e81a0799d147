"""Text, identifiers, digests, filters and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import hashing, metrics, text
from quillmark.operators import dataset
from quillmark.plans.registry import query
from quillmark.sources.tables import table


def _unescaped(column: str) -> str:
    for entity, char in text.ENTITIES.items():
        column = "replace({}, '{}', '{}')".format(column, entity.replace("'", "''"), char.replace("'", "''"))
    return column


@query("t1_amounts", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 1 THEN -CAST(o_custkey AS DOUBLE) - 0.5 ELSE CAST(o_custkey AS DOUBLE) * 1000 + 0.25 END AS amount FROM orders""")
def t1_amounts(spark, sf_dir):
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    written = F.when(k == 4, "[●]").when(k == 1, F.concat(F.lit("("), n, F.lit(".5)"))).when(k == 2, F.concat(F.lit("Rs. "), n, F.lit(",000.25/-"))).otherwise(F.concat(F.lit("₹"), n, F.lit(",000.25")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.amount(written).alias("amount"))


UNIT_HEADINGS = ["(₹ in crore)", "Rs. in lakhs", "Amounts are stated in INR million", "₹ in billions", "in lakhs and in crores", "(in ₹ thousands)", "₹ million", "crore of trees", "Figures in ₹ lakh (₹ in crore)"]
UNIT_NAMES = ["INR_CRORES", "INR_LAKHS", "INR_MILLIONS", "INR_BILLIONS", "INR_LAKHS", "INR_THOUSANDS", "INR_MILLIONS", None, "INR_LAKHS"]


@query("t3_units", f"""SELECT p_partkey, unit, CASE unit WHEN 'INR_CRORES' THEN p_retailprice WHEN 'INR_LAKHS' THEN p_retailprice * 0.01 WHEN 'INR_MILLIONS' THEN p_retailprice * 0.1 WHEN 'INR_BILLIONS' THEN p_retailprice * 100 END AS crore
FROM part JOIN (VALUES {', '.join(f"({i}, {'NULL' if u is None else repr(u)})" for i, u in enumerate(UNIT_NAMES))}) u(i, unit) ON p_partkey % {len(UNIT_NAMES)} = i""")
def t3_units(spark, sf_dir):
    """Units of all kinds of headings; the crore amount is null where the unit is untold or isn't scaled."""
    heading = F.element_at(F.array(*[F.lit(x) for x in UNIT_HEADINGS]), (F.col("p_partkey") % len(UNIT_HEADINGS) + 1).cast("int"))
    named = table(spark, sf_dir, "part").withColumn("unit", text.unit(heading))
    return named.select("p_partkey", "unit", F.when(F.col("unit").isin(*text.UNITS), text.in_crore(F.col("p_retailprice"), F.col("unit"))).alias("crore"))


@query("t2_undisclosed", "SELECT p_partkey, p_partkey % 8 < 6 AS untold FROM part")
def t2_undisclosed(spark, sf_dir):
    written = F.element_at(F.array(*[F.lit(x) for x in ("[●]", "NIL", "N.A.", "--", "Not ascertainable", " nil ", "nil return", "12")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.undisclosed(written).alias("untold"))


HEADINGS = ["THE OFFER ........ 61", "Objects of the Issue", "BASIS FOR ISSUE PRICE", "Our Promoters and Promoter Group", "Restated Consolidated Financial Information", "Consolidated Financial Statements", "Summary of Related Party Transactions", "Outstanding  Litigation and the Offer", "General information"]
SECTION_NAMES = ["the_offer", "objects_of_the_offer", "basis_for_offer_price", "promoters", "restated_financials", "restated_financials", "related_party", "the_offer", None]


@query("t6_sections", f"SELECT section, min(p_partkey) AS first_page, count(*) AS pages FROM part JOIN (VALUES {', '.join(f'({i}, {chr(39) + n + chr(39) if n else chr(78) + chr(85) + chr(76) + chr(76)})' for i, n in enumerate(SECTION_NAMES))}) v(i, section) ON p_partkey % 9 = i WHERE section IS NOT NULL GROUP BY 1")
def t6_sections(spark, sf_dir):
    """First page of each section, where a part is a page with a heading."""
    heading = F.element_at(F.array(*[F.lit(x) for x in HEADINGS]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return dataset.first_pages(table(spark, sf_dir, "part").withColumn("heading", heading), "heading", "p_partkey")


REASONS = ["Resigned due to cessation of interest", "Retired by rotation", "Expiry of his term", "Cessation as Director", "Appointed as CFO", "Redesignated as Chairman", "Change of address", None]
EVENTS = ["resignation", "retirement", "term_expiry", "cessation", "appointment", "appointment", "other", "other"]


@query("t7_board_events", f"SELECT s_suppkey, event, event IN ('resignation', 'cessation', 'retirement', 'term_expiry') AS leaves FROM supplier JOIN (VALUES {', '.join(f'({i}, {e!r})' for i, e in enumerate(EVENTS))}) v(i, event) ON s_suppkey % 8 = i")
def t7_board_events(spark, sf_dir):
    reason = F.element_at(F.array(*[F.lit(x) for x in REASONS]), (F.col("s_suppkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").withColumn("event", text.board_event(reason)).select("s_suppkey", "event", text.is_exit(F.col("event")).alias("leaves"))


@query("t10_displayed", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'ZERO' WHEN 5 THEN 'MALFORMED' ELSE 'AMOUNT' END AS state, CASE c_custkey % 6 WHEN 2 THEN 0.0 WHEN 3 THEN c_custkey * 1000.0 + 0.5 WHEN 4 THEN -CAST(c_custkey AS DOUBLE) END AS amount FROM customer")
def t10_displayed(spark, sf_dir):
    n = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % 6
    shown = F.when(k == 1, " Not quoted yet ").when(k == 2, "₹0").when(k == 3, F.concat(F.lit("₹ "), n, F.lit(",000.5"))).when(k == 4, F.concat(F.lit("-₹"), n)).when(k == 5, F.concat(n, F.lit(" to "), n))
    return table(spark, sf_dir, "customer").withColumn("shown", text.displayed_premium(shown)).select("c_custkey", "shown.state", "shown.amount")


@query("t11_evaluation_ids", "SELECT o_orderkey, 'ipo' || o_custkey || '-FINAL-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS evaluation_id FROM orders")
def t11_evaluation_ids(spark, sf_dir):
    made = text.evaluation_id(F.concat(F.lit("ipo"), "o_custkey"), F.lit("final"), F.col("o_orderdate").cast("timestamp"), F.sha2(F.col("o_orderkey").cast("string"), 256))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("evaluation_id"))


@query("t4_longest_prefix", """SELECT p_partkey, CASE WHEN p_name LIKE 'small ring%' THEN 'small_ring' WHEN p_name LIKE 'small%' THEN 'small' WHEN p_name LIKE 'red%' THEN 'red' END AS category FROM part""")
def t4_longest_prefix(spark, sf_dir):
    prefixes = spark.createDataFrame([("small", "small"), ("small ring", "small_ring"), ("red", "red")], "prefix string, category string")
    return text.longest_prefix(table(spark, sf_dir, "part"), "p_name", prefixes).select("p_partkey", "category")


@query("t5_elimination", "SELECT doc_id, regexp_matches(text, '(?i)\\b(the|and)\\b') AS common, starts_with(source, 'src1') AS first_sources FROM documents")
def t5_elimination(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?i)\b(the|and)\b").alias("common"), F.col("source").startswith("src1").alias("first_sources"))


SYMBOLS = [" nifty 50 tri", "Nifty50", "^NSEI", "nifty 50 index ", "NIFTY50_TRI", "Bank  Nifty", "sensex", "abc ltd"]
NAMES = ["NIFTY_50_TRI", "NIFTY_50", "NIFTY_50", "NIFTY_50", "NIFTY_50_TRI", "BANK__NIFTY", "SENSEX", "ABC_LTD"]


@query("t8_symbols", f"SELECT c_custkey, symbol, contains(symbol, 'NIFTY') AS is_benchmark FROM customer JOIN (VALUES {', '.join(f'({i}, {n!r})' for i, n in enumerate(NAMES))}) v(i, symbol) ON c_custkey % 8 = i")
def t8_symbols(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in SYMBOLS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").withColumn("symbol", text.benchmark_symbol(raw)).select("c_custkey", "symbol", text.is_benchmark(F.col("symbol")).alias("is_benchmark"))


@query("t9_page_text", r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', chr(10), 'g'), '\r\n|[\n\r\x0B\x0C]'),
  lambda x: trim(regexp_replace(html_unescape_, '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM pages""".replace("html_unescape_", _unescaped("x")))
def t9_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.page_text(F.col("html")).alias("body"))


@query("t12_issuer_keys", """SELECT s_suppkey, upper(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || CASE WHEN s_suppkey % 3 = 2 THEN 'PVT' ELSE '' END AS issuer_key, s_suppkey % 3 = 0 AS is_heading FROM supplier""")
def t12_issuer_keys(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    name = F.concat(F.col("s_name"), F.when(k == 0, " Limited").when(k == 1, " LTD. ").otherwise(" Pvt Ltd"))
    heading = F.when(k == 0, F.concat(F.col("s_name"), F.lit(" Ltd IPO Date, Price"))).when(k == 1, F.concat(F.lit("All about "), F.col("s_name"), F.lit(" IPO"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.issuer_key(name).alias("issuer_key"), text.is_issuer_heading(heading, name).alias("is_heading"))


@query("f6_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), 'house')")
def f6_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(text.contains_text(F.col("c_name"), "#00000001") | text.contains_text(F.col("c_mktsegment"), "HOUSE")).select("c_custkey", "c_name")


@query("f5_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def f5_filters(spark, sf_dir):
    given = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("verdict"), F.when(F.col("o_orderstatus") == "F", "Final").otherwise("preliminary").alias("mode"))
    return dataset.listed(given, mode="FINAL", verdict="1-URGENT", o_orderkey=None).select("o_orderkey")


@query("f9_final_only", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def f9_final_only(spark, sf_dir):
    given = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "PRELIMINARY").alias("mode"))
    return dataset.final_only(given).select("o_orderkey")


@query("f7_full_years", "SELECT o_custkey AS ipo_id, count(DISTINCT year(o_orderdate)) FILTER (year(o_orderdate) < 1998) AS years FROM orders GROUP BY 1")
def f7_full_years(spark, sf_dir):
    """Periods but the last, unfinished one."""
    y = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ipo_id"), F.year("o_orderdate").alias("fy")).distinct()
    period = F.struct(F.col("fy").cast("string").alias("fy"), (F.col("fy") >= 1998).alias("is_stub"), *[F.lit(None).cast("double").alias(f) for f in metrics.PERIOD_FIELDS])
    return y.groupBy("ipo_id").agg(F.collect_list(period).alias("periods")).select("ipo_id", F.size(metrics.full_years()).cast("long").alias("years"))


@query("f8_eligible", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R' AND l_discount <> 0 AND l_linestatus = 'F'")
def f8_eligible(spark, sf_dir):
    ok = dataset.eligible(F.col("l_returnflag") == "R", F.when(F.col("l_discount") != 0, F.col("l_discount")), F.when(F.col("l_linestatus") == "F", "VERIFIED").otherwise("UNVERIFIED"))
    return table(spark, sf_dir, "lineitem").where(ok).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f10_visible", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = o.o_orderkey AND e.event_type = 'error')")
def f10_visible(spark, sf_dir):
    return dataset.visible(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id")).select("o_orderkey")


@query("f11_redaction", """SELECT c_custkey, 'Authorization: Bearer [REDACTED] api_key=[REDACTED]&q=' || c_custkey AS header FROM customer""")
def f11_redaction(spark, sf_dir):
    raw = F.concat(F.lit("Authorization: Bearer abc."), "c_custkey", F.lit(" api_key=k"), "c_custkey", F.lit("&q="), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", text.redacted_header(raw).alias("header"))


@query("f12_hosts", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) IN ('tionble.example.org', 'tiontion.example.net') AS allowed FROM pages""")
def f12_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.allowed_host(F.col("url"), ["tionble.example.org", "tiontion.example.net"]).alias("allowed"))


@query("h1_canonical_digests", """SELECT o_orderkey, sha256('{"flags":[true,null],"key":' || o_orderkey || ',"name":"Caf' || chr(233) || ' ' || o_orderstatus || '","total":{"__float__":"' || (o_custkey + 0.5) || '"}}') AS digest FROM orders""")
def h1_canonical_digests(spark, sf_dir):
    """Digests of records in the canonical grammar: keys in order, composed letters, floats marked."""
    o = table(spark, sf_dir, "orders")
    raw = F.concat(F.lit('{"total": '), F.col("o_custkey").cast("string"), F.lit('.5, "name": "Cafe\u0301 '), "o_orderstatus", F.lit('", "key": '), F.col("o_orderkey").cast("string"), F.lit(', "flags": [true, null]}'))
    return o.select("o_orderkey", hashing.json_digest(raw).alias("digest"))


@query("h1_row_digests", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus || chr(31) || CAST(o_custkey AS VARCHAR)) AS digest FROM orders")
def h1_row_digests(spark, sf_dir):
    """Our own fingerprint of rows, apart from the canonical grammar."""
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.row_digest(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey")).alias("digest"))


@query("h2_canonical_json", """SELECT event_id, sha256('{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS digest FROM events""")
def h2_canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hashing.json_digest(F.col("props"), wrapped=False).alias("digest"))


@query("h3_byte_digests", "SELECT page_id, sha256(html) AS digest, octet_length(encode(html)) AS bytes FROM pages")
def h3_byte_digests(spark, sf_dir):
    raw = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("bytes"))


@query("h4_unproven_paths", """SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_filter(['issue.price', CASE WHEN l_discount > 0 THEN 'issue.terms.discount' END, CASE WHEN l_tax > 0 THEN 'issue.terms.tax' END], lambda p: p IS NOT NULL AND p <> CASE WHEN l_returnflag = 'R' THEN 'issue.price' ELSE 'issue.terms.tax' END)), ',') AS unproven FROM lineitem""")
def h4_unproven_paths(spark, sf_dir):
    """Told leaves of a nested record for which no evidence is given."""
    li = table(spark, sf_dir, "lineitem")
    issue = F.struct(F.col("l_extendedprice").alias("price"), F.struct(F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax")).alias("terms"))
    given = li.select("l_orderkey", "l_linenumber", "l_partkey", F.struct(issue.alias("issue")).alias("record"), F.array(F.when(F.col("l_returnflag") == "R", "issue.price").otherwise("issue.terms.tax")).alias("evidence"))
    return given.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(hashing.unproven(hashing.told_paths(given, "record"), F.col("evidence")), ",").alias("unproven"))


@query("h5_merged", """SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 5000 THEN s_acctbal END, CASE WHEN s_nationkey % 2 = 0 THEN 1.0 END, 0.0) AS price, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN s_name END, 'none') AS name FROM supplier""")
def h5_merged(spark, sf_dir):
    """Nested records merged leaf by leaf, the first that tells it."""
    s = table(spark, sf_dir, "supplier")
    record = lambda price, name: F.struct(F.struct(price.cast("double").alias("price"), name.cast("string").alias("name")).alias("issue"))
    even, none = F.col("s_nationkey") % 2 == 0, F.lit(None)
    given = s.select("s_suppkey", record(F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")), none).alias("a"), record(F.when(even, 1.0), F.when(even, F.col("s_name"))).alias("b"), record(F.lit(0.0), F.lit("none")).alias("c"))
    return given.select("s_suppkey", hashing.merged(given, ["a", "b", "c"]).alias("m")).select("s_suppkey", "m.issue.price", "m.issue.name")


@query("h6_payload_digests", """SELECT event_id, sha256('{"kind":"' || event_type || '","user":' || user_id || '}') AS digest FROM events""")
def h6_payload_digests(spark, sf_dir):
    """Digests of snapshots, which leave their ages out."""
    given = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.col("value").alias("age_hours"), F.col("value").alias("age_days")).alias("snapshot"))
    return given.select("event_id", hashing.payload_digest(F.col("snapshot")).alias("digest"))


@query("u1_missing_rows", """SELECT 'criterion' AS kind, CAST(p_partkey AS VARCHAR) AS item, 'small' AS reason FROM part WHERE p_size < 5 UNION ALL SELECT 'peer', CAST(s_suppkey AS VARCHAR), 'overdrawn' FROM supplier WHERE s_acctbal <= 0 UNION ALL SELECT 'block', CAST(event_id AS VARCHAR), 'error' FROM events WHERE event_type = 'error'""")
def u1_missing_rows(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return dataset.missing_rows({
        "criterion": (t("part"), F.col("p_partkey"), F.when(F.col("p_size") < 5, "small")), "peer": (t("supplier"), F.col("s_suppkey"), F.when(F.col("s_acctbal") <= 0, "overdrawn")), "block": (t("events"), F.col("event_id"), F.when(F.col("event_type") == "error", "error")),
    })


@query("u2_removed", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u2_removed(spark, sf_dir):
    return dataset.removed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k")


@query("u3_duplicates", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u3_duplicates(spark, sf_dir):
    from quillmark.operators.validate import duplicates

    return duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("a18_proceeds", "SELECT o_custkey AS ipo_id, o_orderpriority AS category, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS amount, bool_or(o_orderstatus = 'P') AS undisclosed FROM orders GROUP BY 1, 2")
def a18_proceeds(spark, sf_dir):
    cents = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") * 100).cast("long"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ipo_id"), F.col("o_orderpriority").alias("category"), cents.alias("cents"))
    return dataset.by_category(entries, ["ipo_id", "category"], "cents")


@query("a19_sellers", "SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (l_returnflag <> 'N'), 0) AS promoter_sold, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'O'), 0) AS venture_sold, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus <> 'O'), 0) AS other_sold FROM lineitem GROUP BY 1")
def a19_sellers(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "promoter").when(F.col("l_returnflag") == "A", "promoter_group").when(F.col("l_linestatus") == "O", "pe_vc").otherwise("other")
    return dataset.sold_by_kind(table(spark, sf_dir, "lineitem").withColumn("kind", kind), "l_suppkey", "kind", "l_quantity")


@query("j10_identity", """SELECT event_id, CASE WHEN o_orderkey IS NULL THEN 'UNBOUND' WHEN event_type = 'error' THEN 'INCOMPLETE' WHEN value >= 50 THEN 'STALE_OR_DIFFERENT' WHEN event_type <> 'view' AND o_custkey <> user_id THEN 'CONFLICT' ELSE 'BOUND' END AS binding FROM events LEFT JOIN orders ON o_orderkey = event_id""")
def j10_identity(spark, sf_dir):
    """Events are captures of the order with their number: errors tell no window, large values another one, views no customer."""
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("a").alias("opened"), F.lit("b").alias("closed"), F.col("o_custkey").alias("customer"))
    told = F.col("event_type") != "error"
    captures = table(spark, sf_dir, "events").select("event_id", F.when(told, F.when(F.col("value") >= 50, "x").otherwise("a")).alias("opened"), F.when(told, "b").alias("closed"), F.when(F.col("event_type") != "view", F.col("user_id")).alias("customer"))
    return dataset.identity(captures, issues, "event_id", "opened", "closed", ["customer"]).select("event_id", "binding")


@query("j9_evidence", """SELECT s_suppkey, n_name, CASE WHEN n_nationkey IS NULL THEN 'DANGLING_SOURCE' END AS code FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON s_nationkey = n_nationkey""")
def j9_evidence(spark, sf_dir):
    """Suppliers as evidence, nations as sources of which a region's are lost."""
    found, dangling = dataset.resolved(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey <> 1"), "s_nationkey", "n_nationkey")
    return found.select("s_suppkey", "n_name", F.lit(None).cast("string").alias("code")).unionByName(dangling.select("s_suppkey", F.lit(None).cast("string").alias("n_name"), "code"))
