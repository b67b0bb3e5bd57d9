"""Reference results of the registered queries as plain SQL over the given tables.

Written from the meaning of each check, with ordinary windows and joins, independently of how
the Spark plans compute it.
"""

from __future__ import annotations


def _text(cents: str) -> str:
    """SQL text of an amount in cents: 1,234.50."""
    return (
        f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || format('{{:,}}', abs({cents}) // 100) || '.' || "
        f"lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0'))"
    )


def _money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


LEDGER = """
base AS (
  SELECT o_custkey AS doc_id, o_orderkey AS okey, CAST(o_orderdate AS DATE) AS txn_date,
         o_orderstatus = 'F' AS is_in, o_orderpriority AS prio,
         CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) % 100000
              ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents
  FROM orders),
num AS (
  SELECT *, row_number() OVER w AS txn_seq,
         CAST(sum(CASE WHEN is_in THEN cents ELSE -cents END) OVER w AS BIGINT) AS run
  FROM base WINDOW w AS (PARTITION BY doc_id ORDER BY txn_date, okey ROWS UNBOUNDED PRECEDING)),
led AS (
  SELECT doc_id, okey, txn_seq, txn_date, strftime(txn_date, '%d/%m/%Y') AS date_raw,
         2 + (txn_seq - 1) // 10 AS page, (txn_seq - 1) % 10 AS slot, run,
         (CASE okey % 5 WHEN 0 THEN 'PAYNOW' WHEN 1 THEN 'ATM' WHEN 2 THEN 'SALARY'
                        WHEN 3 THEN 'POINT-OF-SALE' ELSE 'GIRO' END) || ' ' || prio AS title,
         (CASE okey % 5 WHEN 0 THEN 'PAYNOW' WHEN 1 THEN 'ATM' WHEN 2 THEN 'SALARY'
                        WHEN 3 THEN 'POINT-OF-SALE' ELSE 'GIRO' END) || ' ' || prio
           || CASE WHEN okey % 7 = 0 THEN ' REF ' || okey ELSE '' END AS description,
         CASE WHEN NOT is_in THEN cents WHEN okey % 83 = 0 THEN 100 END AS w,
         CASE WHEN is_in THEN cents WHEN okey % 83 = 0 THEN 100 END AS d,
         CASE WHEN okey % 89 <> 0 THEN 2000000000 + run + CASE WHEN okey % 97 = 0 THEN 100 ELSE 0 END END AS b
  FROM num)"""

DOCS = """
docs AS (
  SELECT c_custkey AS doc_id,
         CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 + (coalesce(n, 0) + 9) // 10 END AS n_pages
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""

# What a faithful extraction reads back from the rendered words.
PARSED = LEDGER + """,
shown AS (SELECT * FROM led WHERE doc_id % 50 <> 0 AND NOT (doc_id % 51 = 0 AND page = 3)),
own AS (
  SELECT *, CASE WHEN okey % 3 <> 0 THEN w END AS ow, CASE WHEN okey % 3 <> 0 THEN d END AS od,
         abs(b) AS ob FROM shown),
fix1 AS (
  SELECT *, coalesce(ow > 100000 AND coalesce(ob, 0) = 0, FALSE) AS mw FROM own),
fix2 AS (
  SELECT *, CASE WHEN mw THEN ow ELSE ob END AS b1, CASE WHEN NOT mw THEN ow END AS w1 FROM fix1),
fix3 AS (
  SELECT *, coalesce(od > 100000 AND coalesce(b1, 0) = 0, FALSE) AS md FROM fix2),
parsed AS (
  SELECT doc_id, okey, page, slot, date_raw, txn_date, description, mw OR md AS reclassified,
         row_number() OVER (PARTITION BY doc_id ORDER BY page, slot) AS txn_seq,
         CASE WHEN okey % 3 = 0 THEN w ELSE w1 END AS pw,
         CASE WHEN okey % 3 = 0 THEN d WHEN NOT md THEN od END AS pd,
         CASE WHEN md THEN od ELSE b1 END AS pb,
         coalesce(b < 0, FALSE) AS negative
  FROM fix3)"""

RESULTS = PARSED + "," + DOCS + """,
results AS (
  SELECT docs.doc_id, n_pages, n_pages > 0 AS success,
         CASE WHEN n_pages = 0 THEN 0.0 ELSE round(CAST(CASE WHEN docs.doc_id % 11 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE)
              * CAST(CASE WHEN docs.doc_id % 7 = 0 THEN 0.7 ELSE 1.0 END AS DOUBLE), 6) END AS confidence,
         CASE WHEN n_pages = 0 THEN 'Empty document' ELSE concat_ws('; ',
              CASE WHEN docs.doc_id % 11 = 0 THEN 'Insufficient text content - possible OCR needed' END,
              CASE WHEN docs.doc_id % 7 = 0 THEN 'Expected headers not found' END,
              'Could not find transaction table on page 1',
              CASE WHEN docs.doc_id % 51 = 0 AND n_pages >= 3 THEN 'No text found on page 3' END) END AS warnings,
         CASE WHEN n_pages = 0 THEN 'Document integrity check failed' END AS abort_reason,
         coalesce(n, 0) AS transaction_count
  FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM parsed GROUP BY 1) c ON c.doc_id = docs.doc_id)"""

_FOOT_TOTAL = "((doc_id % 1000) * 100 + 50 + CASE WHEN doc_id % 26 = 0 THEN page * 100 ELSE 0 END)"


def _fixed(condition: str, source: str, items: list[tuple[int, float, float, str]]) -> str:
    rows = ", ".join(f"({o}, {x}, {y}, '{t}')" for o, x, y, t in items)
    return (
        f"SELECT doc_id, page, f.o AS ord, CAST(f.x AS DOUBLE) AS x0, CAST(f.y AS DOUBLE) AS y0, f.t AS text, "
        f"CAST(f.y AS DOUBLE) AS ly FROM {source}, (VALUES {rows}) f(o, x, y, t) WHERE {condition}"
    )


def _one(source: str, condition: str, ord_: str, x: str, y: str, text: str, key: str | None = None) -> str:
    return (
        f"SELECT doc_id, page, {ord_} AS ord, CAST({x} AS DOUBLE) AS x0, CAST({y} AS DOUBLE) AS y0, "
        f"{text} AS text, CAST({key or y} AS DOUBLE) AS ly FROM {source} WHERE {condition}"
    )


def _phrase(source: str, condition: str, text: str, ord_: str, x: str, y: str, wobble: str = "0") -> str:
    return (
        f"SELECT doc_id, page, {ord_} + i AS ord, CAST({x} + 50 * i AS DOUBLE) AS x0, "
        f"CAST({y} + {wobble} AS DOUBLE) AS y0, t AS text, CAST({y} AS DOUBLE) AS ly FROM ("
        f"SELECT *, unnest(string_split({text}, ' ')) AS t, "
        f"unnest(range(len(string_split({text}, ' ')))) AS i FROM {source} WHERE {condition})"
    )


_Y = "240 + 24 * slot"
_LOW = "240 + 24 * slot + CASE WHEN okey % 3 = 0 THEN 3 ELSE 0 END"
_AT = "100 + slot * 20"
_WORDS = [
    _one("shown", "TRUE", _AT, "45.4", _Y, "date_raw"),
    _phrase("shown", "TRUE", "title", f"{_AT} + 1", "113", _Y, "0.25 * ((okey + i) % 3)"),
    _one("shown", "w IS NOT NULL", f"{_AT} + 10", "373.6", _LOW, _text("w")),
    _one("shown", "d IS NOT NULL", f"{_AT} + 11", "450.1", _LOW, _text("d")),
    _one("shown", "b IS NOT NULL", f"{_AT} + 12", "512.6", _Y, _text("b")),
    _phrase("shown", "okey % 7 = 0", "('REF ' || okey)", f"{_AT} + 15", "113", f"{_Y} + 12"),
    _fixed("slot = 0", "shown", [
        (1, 45.4, 190, "Date"), (2, 113, 190, "Description"), (3, 373.6, 190, "Withdrawal"),
        (4, 450.1, 190, "Deposit"), (5, 512.6, 190, "Balance"), (6, 45.4, 220, "CURRENCY:"), (7, 120, 220, "SGD"),
    ]),
    _fixed("slot = 0 AND page = 2", "shown", [
        (8, 45.4, 228, "01/01/1992"), (9, 113, 228, "Balance"), (10, 163, 228, "Brought"),
        (11, 213, 228, "Forward"), (12, 512.6, 228, "20,000,000.00"),
    ]),
    _phrase("shown", "slot = 0 AND page > 2 AND (doc_id + page) % 5 = 0", "('CONTD ' || page)", "13", "113", "230"),
    _fixed("slot = 0 AND doc_id % 2 = 0", "shown", [
        (1000, 113, 500, "Total"), (1001, 163, 500, "Balance"), (1002, 213, 500, "Carried"), (1003, 263, 500, "Forward"),
    ]),
    _one("shown", "slot = 0 AND doc_id % 2 = 0", "1004", "512.6", "500", _text(_FOOT_TOTAL)),
    _fixed("slot = 0 AND doc_id % 3 <> 0", "shown", [(1010, 45.4, 780, "Page")]),
    _one("shown", "slot = 0 AND doc_id % 3 <> 0", "1011", "80", "780", "CAST(page AS VARCHAR)"),
    _phrase("cover", "TRUE", "head", "1", "45.4", "100"),
    _phrase("cover", "doc_id % 11 <> 0", "body", "10", "45.4", "120"),
    _phrase("cover", "TRUE", "'Page 1'", "30", "45.4", "140"),
]

WORDS = LEDGER + "," + DOCS + """,
shown AS (SELECT * FROM led WHERE doc_id % 50 <> 0 AND NOT (doc_id % 51 = 0 AND page = 3)),
cover AS (
  SELECT doc_id, 1 AS page, CASE WHEN doc_id % 7 = 0 THEN 'Statement Overview' ELSE 'Account Summary' END AS head,
         'Consolidated statement of all deposits and payments for customer ' || doc_id AS body
  FROM docs WHERE n_pages > 0),
words AS (
""" + "\nUNION ALL\n".join(_WORDS) + """),
grid AS (SELECT *, round_even(y0 / 3, 0) * 3 AS gy FROM words)"""

# Words of grid lines that begin with a date, with their role.
ROLES = WORDS + """,
glines AS (
  SELECT doc_id, page, gy, string_agg(text, ' ' ORDER BY x0, ord) AS line_text, count(*) AS n_words
  FROM grid GROUP BY 1, 2, 3),
dlines AS (SELECT * FROM glines WHERE regexp_matches(line_text, '^[0-9]{2}/[0-9]{2}/[0-9]{4}')),
roles AS (
  SELECT g.*, CASE WHEN regexp_matches(text, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') THEN 'date'
                   WHEN regexp_matches(text, '^[0-9,]+\\.[0-9]{2}$') THEN 'amount'
                   WHEN length(text) > 2 AND NOT regexp_matches(text, '^[0-9,.]+$') THEN 'description'
                   ELSE 'other' END AS role
  FROM grid g SEMI JOIN dlines USING (doc_id, page, gy)),
amounts AS (
  SELECT *, CAST(replace(text, ',', '') AS DECIMAL(18, 2)) AS amount FROM roles WHERE role = 'amount')"""

CLUSTERS = """
jumps AS (
  SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0) < 50 THEN 0 ELSE 1 END AS jump FROM {src}),
placed AS (
  SELECT *, sum(jump) OVER (PARTITION BY doc_id ORDER BY x0, page, gy, ord ROWS UNBOUNDED PRECEDING) AS cluster
  FROM (SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY doc_id, x0 ORDER BY page, gy, ord) = 1
                               THEN first_jump ELSE 0 END AS jump)
        FROM (SELECT *, max(jump) OVER (PARTITION BY doc_id, x0) AS first_jump FROM jumps)))"""

_CL = CLUSTERS.format(src="amounts")


def _bounds_cte(roles: str, amounts: str) -> str:
    return CLUSTERS.format(src=amounts) + f""",
means AS (SELECT doc_id, cluster, avg(x0) AS m FROM placed GROUP BY 1, 2),
wide AS (
  SELECT doc_id, count(*) AS n_clusters, max(CASE WHEN cluster = 1 THEN m END) AS m1,
         max(CASE WHEN cluster = 2 THEN m END) AS m2, max(CASE WHEN cluster = 3 THEN m END) AS m3
  FROM means GROUP BY 1),
sides AS (
  SELECT doc_id, max(CASE WHEN role = 'date' THEN x0 END) AS dmax, min(CASE WHEN role = 'description' THEN x0 END) AS dmin
  FROM {roles} GROUP BY 1),
bounds AS (
  SELECT doc_id, n_clusters, dmax + 10 AS date_right_x, dmin - 10 AS description_x, m1 - 10 AS description_right_x,
         CASE WHEN n_clusters >= 3 THEN m1 - 10 END AS withdrawal_x, CASE WHEN n_clusters >= 3 THEN m2 - 10 END AS deposit_x,
         CASE WHEN n_clusters = 2 THEN m1 - 10 END AS amount_x,
         CASE WHEN n_clusters >= 3 THEN m3 WHEN n_clusters = 2 THEN m2 ELSE m1 END - 10 AS balance_x
  FROM wide JOIN sides USING (doc_id) WHERE dmax IS NOT NULL AND dmin IS NOT NULL)"""


# Amounts where the three layouts put them; a layout's edges are the means of all its amounts left of, in and right of the middle.
_SHIFTED = """
roles_s AS (SELECT * REPLACE (CASE WHEN page > 1 AND x0 > 300 THEN x0 + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN -40 ELSE 12 END
              + (doc_id % 5 - 2) * 0.5 ELSE x0 END AS x0) FROM roles),
amounts_s AS (SELECT * FROM roles_s WHERE role = 'amount'),"""
_SHIFTED_BOUNDS = _SHIFTED + _bounds_cte("roles_s", "amounts_s") + """,
spots AS (SELECT doc_id % 3 AS layout, x0, x0 - CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN -40 ELSE 12 END AS plain FROM amounts_s),
pools AS (SELECT layout, avg(x0) FILTER (plain < 410) - 10 AS p1, avg(x0) FILTER (plain BETWEEN 410 AND 480) - 10 AS p2,
                 avg(x0) FILTER (plain > 480) - 10 AS p3 FROM spots GROUP BY 1)"""

_BOUNDS_SELECT = """SELECT doc_id, n_clusters, round(date_right_x, 6) AS date_right_x,
  round(description_x, 6) AS description_x, round(description_right_x, 6) AS description_right_x,
  round(withdrawal_x, 6) AS withdrawal_x, round(deposit_x, 6) AS deposit_x, round(amount_x, 6) AS amount_x,
  round(balance_x, 6) AS balance_x FROM bounds"""

_PARSED_COLUMNS = f"""doc_id, page, txn_seq, date_raw, CAST(txn_date AS VARCHAR) AS txn_date, description,
  {_money('pw')} AS withdrawal, {_money('pd')} AS deposit, {_money('pb')} AS balance"""
_LEDGER_COLUMNS = f"""doc_id, page, txn_seq, date_raw, CAST(txn_date AS VARCHAR) AS txn_date, description,
  {_money('w')} AS withdrawal, {_money('d')} AS deposit, {_money('b')} AS balance"""


def _with(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


_CONTINUITY = """
prev AS (SELECT *, lag({b}) OVER (PARTITION BY doc_id ORDER BY txn_seq) AS pb0 FROM {src}),
cont AS (
  SELECT *, pb0 - coalesce({w}, 0) + coalesce({d}, 0) AS expected,
         {b} - (pb0 - coalesce({w}, 0) + coalesce({d}, 0)) AS diff FROM prev),
checked AS (
  SELECT *, CASE WHEN txn_seq = 1 THEN 'FIRST' WHEN diff IS NULL THEN 'UNVERIFIABLE'
                 WHEN abs(diff) > 1 THEN 'BREAK' ELSE 'OK' END AS status FROM cont)"""
_LED_CONT = LEDGER + "," + _CONTINUITY.format(b="b", w="w", d="d", src="led")
_PARSED_CONT = RESULTS + "," + _CONTINUITY.format(b="pb", w="pw", d="pd", src="parsed")

_TEXT_WARNINGS = """concat_ws('; ',
  CASE WHEN short THEN 'Insufficient text content - possible OCR needed' END,
  CASE WHEN no_header THEN 'Expected headers not found' END)"""

# Warnings of the document, how many there are with those of its pages, and the latter one by one.
_OWN = "array_to_string(list_filter(string_split(warnings, '; '), lambda x: NOT contains(x, ' on page ')), '; ')"
_N_WARNINGS = "CAST(len(list_filter(string_split(warnings, '; '), lambda x: x <> '')) AS BIGINT)"

_DISPLAY = lambda c: f"CASE WHEN {c} <> 0 THEN {_money(c)} END"

_RESCANNED = LEDGER + """,
twice AS (SELECT * FROM led UNION ALL BY NAME
          SELECT * REPLACE (txn_seq + 1000000000 AS txn_seq) FROM led WHERE okey % 79 = 0)"""

_CORRECTED = LEDGER + """,
fixed AS (
  SELECT *, CASE WHEN okey % 82 = 0 THEN 5678 WHEN okey % 41 = 0 THEN 1234 ELSE w END AS nw,
         CASE WHEN okey % 43 = 0 THEN 'CORRECTED' ELSE description END AS nt,
         CASE WHEN okey % 47 = 0 THEN NULL ELSE b END AS nb
  FROM led)"""


def _plain(cents: str) -> str:
    """An amount as Spark writes a decimal: no thousands separators."""
    return f"CAST(CAST({cents} AS DECIMAL(20, 0)) * 0.01 AS DECIMAL(18, 2))::VARCHAR"


_SUMMARY = """
agg AS (
  SELECT doc_id, count(*) AS n, count({w}) AS nw, count({d}) AS nd,
         coalesce(sum({w}), 0) AS sw, coalesce(sum({d}), 0) AS sd,
         max(CASE WHEN txn_seq = 1 THEN {b} END) AS fb,
         max(CASE WHEN txn_seq = 1 THEN {b} + coalesce({w}, 0) - coalesce({d}, 0) END) AS ob,
         max(CASE WHEN txn_seq = last_seq THEN {b} END) AS lb,
         max(CASE WHEN txn_seq = first_ok THEN {b} END) AS nfb
  FROM (SELECT *, max(txn_seq) OVER (PARTITION BY doc_id) AS last_seq,
               min(CASE WHEN coalesce({b}, 0) <> 0 THEN txn_seq END) OVER (PARTITION BY doc_id) AS first_ok FROM {src})
  GROUP BY 1)"""
_LED_SUM = LEDGER + "," + _SUMMARY.format(w="w", d="d", b="b", src="led")

ORACLE: dict[str, str] = {
    "statement_totals": _with(PARSED, f"""SELECT doc_id, count(*) AS n_transactions,
        {_money('coalesce(sum(pw), 0)')} AS total_withdrawals, {_money('coalesce(sum(pd), 0)')} AS total_deposits,
        {_money('coalesce(sum(pd), 0) - coalesce(sum(pw), 0)')} AS net_change FROM parsed GROUP BY doc_id"""),
    "parse_roundtrip": _with(PARSED, f"SELECT {_PARSED_COLUMNS}, reclassified, negative FROM parsed"),
    "carry_pages": _with(PARSED + """,
        pages AS (SELECT doc_id, page, max(slot) AS last_slot, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS next
                  FROM parsed GROUP BY doc_id, page),
        carried AS (SELECT p.* REPLACE (CASE WHEN slot = last_slot AND next > 2 AND (p.doc_id + next) % 5 = 0
                                             THEN description || ' CONTD ' || next ELSE description END AS description)
                    FROM parsed p JOIN pages USING (doc_id, page))""",
        f"SELECT {_PARSED_COLUMNS} FROM carried"),
    "learned_columns": _with(PARSED, f"SELECT {_PARSED_COLUMNS} FROM parsed"),
    "page_list": _with(WORDS, "SELECT doc_id, CAST(page AS BIGINT) AS page, count(*) AS n_words FROM words GROUP BY 1, 2"),
    "page_text": _with(WORDS, """SELECT doc_id, head || chr(10) || CASE WHEN doc_id % 11 <> 0 THEN body || chr(10) ELSE '' END
        || 'Page 1' AS page_text FROM cover"""),
    "lines_greedy": _with(WORDS, r"""SELECT doc_id, CAST(page AS BIGINT) AS page,
        row_number() OVER (PARTITION BY doc_id, page ORDER BY ly) - 1 AS line_idx, ly AS line_y, line_text, n_amounts
        FROM (SELECT doc_id, page, ly, string_agg(text, ' ' ORDER BY x0, ord) AS line_text,
                     count(*) FILTER (WHERE regexp_matches(regexp_replace(text, '[^0-9,.]', '', 'g'), '^[0-9,]+\.[0-9]{2}$')) AS n_amounts
              FROM words GROUP BY 1, 2, 3)"""),
    "lines_grid": _with(WORDS, """SELECT doc_id, CAST(page AS BIGINT) AS page, gy AS line_y,
        string_agg(text, ' ' ORDER BY x0, ord) AS line_text FROM grid GROUP BY 1, 2, 3"""),
    "normalise_xy": _with(WORDS, """SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(ord AS BIGINT) AS ord,
        842 - (y0 + 9) AS y0, 842 - y0 AS y1 FROM words"""),
    "span_merge": _with(WORDS + """,
        frag AS (
          SELECT doc_id, page, gy, ord * 2 AS ord, x0, CASE WHEN length(text) > 3 THEN text[1:2] ELSE text END AS text FROM grid
          UNION ALL SELECT doc_id, page, gy, ord * 2 + 1, x0 + 10.5, text[3:] FROM grid WHERE length(text) > 3),
        gaps AS (SELECT *, CASE WHEN x0 - lag(x0 + 5 * length(text)) OVER w <= 1 THEN 0 ELSE 1 END AS apart
                 FROM frag WINDOW w AS (PARTITION BY doc_id, page, gy ORDER BY x0, ord)),
        isl AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page, gy ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS span
                FROM gaps)""", """SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(span AS BIGINT) AS span, gy AS line_y,
        min(x0) AS x0, string_agg(text, '' ORDER BY x0, ord) AS text, count(*) AS n_parts FROM isl GROUP BY doc_id, page, span, gy"""),
    "amount_tokens": rf"""WITH priced AS (
          SELECT o_orderkey % 8 AS k, {_text('c')} AS t FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)),
        tok AS (
          SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents
          UNION ALL SELECT CASE k WHEN 0 THEN t WHEN 1 THEN '-' || t WHEN 2 THEN '(' || t || ')' WHEN 3 THEN 'SGD' || t
            WHEN 4 THEN t || '%' WHEN 5 THEN '12/' || t WHEN 6 THEN t || '0' ELSE '1.' || t END FROM priced),
        kept AS (SELECT *, regexp_replace(token, '[^0-9,.]', '', 'g') AS k FROM tok)
        SELECT token, CAST(any_value(TRY_CAST(replace(k, ',', '') AS DECIMAL(18, 2))) AS DOUBLE) AS value,
               regexp_matches(token, '[-(−]') AS negative, count(*) AS n
        FROM kept WHERE regexp_matches(k, '^[0-9,]+\.[0-9]{{2}}$') AND TRY_CAST(replace(k, ',', '') AS DECIMAL(18, 2)) IS NOT NULL
        GROUP BY token""",
    "text_rows": _with(LEDGER + f""",
        flat AS (SELECT *, list_filter([w, d, b], lambda x: x IS NOT NULL) AS am FROM led),
        txt AS (SELECT *, list_transform(am, lambda x: {_text('x')}) AS av FROM flat),
        des AS (SELECT *, trim(replace(replace(replace(concat_ws(' ', title, av[1], av[2], av[3]),
                  coalesce(av[1], '~'), ''), coalesce(av[2], '~'), ''), coalesce(av[3], '~'), '')) AS dtext,
                CASE WHEN len(am) = 2 AND abs(am[1]) <> 0 THEN abs(am[1]) END AS single FROM txt)""",
        f"""SELECT doc_id, txn_seq, date_raw, CAST(txn_date AS VARCHAR) AS txn_date, dtext AS description,
        {_money("CASE WHEN len(am) = 3 THEN abs(w) WHEN okey % 5 = 1 THEN single END")} AS withdrawal,
        {_money("CASE WHEN len(am) = 3 THEN abs(d) WHEN okey % 5 = 2 THEN single END")} AS deposit,
        {_money("abs(am[len(am)])")} AS balance FROM des"""),
    "large_amount_repair": _with(LEDGER + """,
        r1 AS (SELECT *, coalesce(w > 100000 AND coalesce(b, 0) = 0, FALSE) AS mw FROM led),
        r2 AS (SELECT *, CASE WHEN mw THEN w ELSE b END AS b1 FROM r1),
        r3 AS (SELECT *, coalesce(d > 100000 AND coalesce(b1, 0) = 0, FALSE) AS md FROM r2)""",
        f"""SELECT doc_id, txn_seq, {_money('CASE WHEN NOT mw THEN w END')} AS withdrawal,
        {_money('CASE WHEN NOT md THEN d END')} AS deposit, {_money('CASE WHEN md THEN d ELSE b1 END')} AS balance,
        mw OR md AS reclassified FROM r3"""),
    "doc_guard": rf"""WITH flags AS (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 AS short,
          NOT (contains(text, 'Transaction Details') OR contains(text, 'Account Summary')) AS no_header
          FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
        SELECT doc_id, TRUE AS success, round(CAST(CASE WHEN short THEN 0.5 ELSE 1.0 END AS DOUBLE)
          * CAST(CASE WHEN no_header THEN 0.7 ELSE 1.0 END AS DOUBLE), 6) AS confidence, {_TEXT_WARNINGS} AS warnings FROM flags""",
    "doc_results": _with(RESULTS + """,
        lost AS (SELECT doc_id, count(*) AS k FROM shown WHERE slot = 0 AND doc_id % 37 BETWEEN 1 AND 3 GROUP BY 1)""", f"""
        SELECT r.doc_id, success AND k IS NULL AS success, CASE WHEN k IS NULL THEN confidence ELSE 0.0 END AS confidence, {_OWN} AS warnings,
        {_N_WARNINGS} AS n_warnings, coalesce(abort_reason, k || ' malformed words') AS abort_reason,
        CASE WHEN k IS NULL THEN transaction_count ELSE 0 END AS transaction_count
        FROM (SELECT * REPLACE (CASE WHEN doc_id % 37 = 4 AND n_pages > 0 AND doc_id % 11 = 0 AND doc_id % 7 <> 0
                THEN replace(warnings, 'Could not find', 'Expected headers not found; Could not find')
                WHEN doc_id % 37 = 4 AND n_pages > 0 AND doc_id % 7 <> 0 THEN 'Expected headers not found; ' || warnings ELSE warnings END AS warnings,
              CASE WHEN doc_id % 37 = 4 AND n_pages > 0 AND doc_id % 7 <> 0 THEN round(confidence * 0.7, 6) ELSE confidence END AS confidence) FROM results) r
        LEFT JOIN lost ON lost.doc_id = r.doc_id"""),
    "page_warnings": _with(RESULTS, """SELECT doc_id, CAST(regexp_extract(m, '[0-9]+$') AS BIGINT) AS page, m AS message
        FROM (SELECT doc_id, unnest(string_split(warnings, '; ')) AS m FROM results) WHERE contains(m, ' on page ')"""),
    "rejected_words": _with(WORDS, """SELECT CASE WHEN doc_id % 37 < 4 THEN doc_id END AS doc_id,
        CASE doc_id % 37 WHEN 1 THEN 'no position' WHEN 2 THEN 'no page' WHEN 3 THEN 'no text' ELSE 'no document' END AS reason,
        count(*) AS n_words, CASE WHEN min(doc_id % 37) < 4 THEN count(*) || ' malformed words' END AS abort_reason
        FROM words WHERE (doc_id % 37 BETWEEN 1 AND 3 AND ord = doc_id % 37 + 2) OR (doc_id % 37 = 4 AND ord = 2) GROUP BY 1, 2"""),
    "aborted_results": _with(RESULTS + """,
        bad AS (SELECT doc_id FROM shown WHERE doc_id % 26 = 0 GROUP BY doc_id HAVING count(DISTINCT page) > 1)""",
        f"""SELECT r.doc_id, success AND bad.doc_id IS NULL AS success,
        CASE WHEN bad.doc_id IS NULL THEN confidence ELSE 0.0 END AS confidence, {_OWN} AS warnings, {_N_WARNINGS} AS n_warnings,
        coalesce(abort_reason, CASE WHEN bad.doc_id IS NOT NULL THEN 'Multiple conflicting totals' END) AS abort_reason,
        CASE WHEN bad.doc_id IS NULL THEN transaction_count ELSE 0 END AS transaction_count
        FROM results r LEFT JOIN bad ON bad.doc_id = r.doc_id"""),
    "route": _with(RESULTS, """SELECT doc_id, confidence,
        CASE WHEN NOT success OR confidence < 0.8 THEN 'fallback' ELSE 'deterministic' END AS route FROM results"""),
    "statement_report": _with(RESULTS + "," + _SUMMARY.format(w="pw", d="pd", b="pb", src="parsed"), f"""
        SELECT r.doc_id, success, transaction_count,
        CAST(CASE WHEN n_pages = 0 THEN 1 ELSE 1 + CASE WHEN r.doc_id % 11 = 0 THEN 1 ELSE 0 END
          + CASE WHEN r.doc_id % 7 = 0 THEN 1 ELSE 0 END
          + CASE WHEN r.doc_id % 51 = 0 AND n_pages >= 3 THEN 1 ELSE 0 END END AS BIGINT) AS n_warnings,
        {_money('sw')} AS total_withdrawals, {_money('sd')} AS total_deposits, {_money('sd - sw')} AS net_change,
        {_money('fb')} AS first_balance, {_money('lb')} AS closing_balance, {_money('lb - fb')} AS calculated_change,
        {_money('ob')} AS opening_balance, {_money('lb - ob')} AS actual_change
        FROM results r LEFT JOIN agg ON agg.doc_id = r.doc_id"""),
    "entropy": """WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, length(text) AS n FROM documents),
        cnt AS (SELECT doc_id, c, n, count(*) AS k FROM ch GROUP BY 1, 2, 3),
        h AS (SELECT doc_id, -sum(k / n * log2(k / n)) AS h FROM cnt GROUP BY 1)
        SELECT d.doc_id, round(coalesce(h, 0.0), 6) AS entropy FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""",
    "word_entropy": _with(WORDS + """,
        ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM words),
        cnt AS (SELECT doc_id, c, count(*) AS k FROM ch GROUP BY 1, 2),
        tot AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n FROM cnt GROUP BY 1)""",
        """SELECT tot.doc_id, max(n) AS n_chars, round(-sum(k / n * log2(k / n)), 6) AS entropy
        FROM cnt JOIN tot USING (doc_id) GROUP BY tot.doc_id"""),
    "fingerprint": _with(ROLES + "," + _bounds_cte("roles", "amounts") + """,
        prints AS (SELECT doc_id, sha256(concat_ws('|', n_clusters,
            coalesce(CAST(CAST(floor(withdrawal_x / 5) AS BIGINT) AS VARCHAR), '-'),
            coalesce(CAST(CAST(floor(deposit_x / 5) AS BIGINT) AS VARCHAR), '-'),
            coalesce(CAST(CAST(floor(amount_x / 5) AS BIGINT) AS VARCHAR), '-'),
            coalesce(CAST(CAST(floor(balance_x / 5) AS BIGINT) AS VARCHAR), '-'))) AS fp FROM bounds),
        known AS (SELECT fp FROM prints GROUP BY 1 HAVING count(*) > 1)""",
        """SELECT CASE WHEN known.fp IS NOT NULL THEN 'layout-' || substr(prints.fp, 1, 8) END AS template,
        count(*) AS n_docs FROM prints LEFT JOIN known ON known.fp = prints.fp GROUP BY 1"""),
    "template_match": _with(ROLES + "," + _bounds_cte("roles", "amounts") + """,
        moved AS (SELECT doc_id, n_clusters, withdrawal_x + off AS wx, deposit_x + off AS dx, amount_x + off AS ax, balance_x + off AS bx
                  FROM (SELECT *, doc_id % 23 * 0.47::DOUBLE - doc_id % 3 * 8.13::DOUBLE AS off FROM bounds)),
        known AS (SELECT *, doc_id AS template FROM moved WHERE doc_id % 40 = 7),
        far AS (SELECT m.doc_id, template, round(greatest(coalesce(abs(m.wx - k.wx), 0), coalesce(abs(m.dx - k.dx), 0),
                       coalesce(abs(m.ax - k.ax), 0), coalesce(abs(m.bx - k.bx), 0)), 6) AS distance
                FROM moved m JOIN known k ON m.n_clusters = k.n_clusters),
        best AS (SELECT * FROM far WHERE distance <= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, template) = 1)""",
        "SELECT moved.doc_id, best.template, round(best.distance, 6) AS distance FROM moved LEFT JOIN best ON best.doc_id = moved.doc_id"),
    "column_sources": _with(ROLES + "," + _SHIFTED_BOUNDS, """SELECT b.doc_id, CASE WHEN n_clusters >= 3 THEN 'document' ELSE 'template' END AS source,
        round(CASE WHEN n_clusters >= 3 THEN withdrawal_x ELSE p1 END, 6) AS withdrawal_x, round(CASE WHEN n_clusters >= 3 THEN deposit_x ELSE p2 END, 6) AS deposit_x,
        round(CASE WHEN n_clusters >= 3 THEN balance_x ELSE p3 END, 6) AS balance_x FROM bounds b JOIN pools ON pools.layout = b.doc_id % 3"""),
    "transaction_trace": _with(ROLES, """SELECT doc_id, CAST(page AS BIGINT) AS page, gy AS line_y,
        substr(line_text, 1, 100) AS full_text, n_words FROM dlines"""),
    "word_roles": _with(ROLES, """SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(ord AS BIGINT) AS ord, gy AS line_y, x0, text, role,
        CASE WHEN role = 'amount' THEN CAST(CAST(replace(text, ',', '') AS DECIMAL(18, 2)) AS DOUBLE) END AS amount FROM roles"""),
    "position_stats": _with(ROLES, """SELECT doc_id, role, count(*) AS n, min(x0) AS min_x, max(x0) AS max_x,
        round(avg(x0), 6) AS mean_x FROM roles WHERE role <> 'other' GROUP BY doc_id, role"""),
    "amount_clusters": _with(ROLES + "," + _CL, """SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(x0) AS min_x,
        max(x0) AS max_x, round(avg(x0), 6) AS mean_x,
        array_to_string(list(CAST(amount AS VARCHAR) ORDER BY x0, page, gy, ord)[1:5], '; ') AS sample_amounts
        FROM placed GROUP BY doc_id, cluster"""),
    "column_bounds": _with(ROLES + "," + _bounds_cte("roles", "amounts"), _BOUNDS_SELECT),
    "sampled_bounds": _with(ROLES + """,
        firstp AS (SELECT doc_id, min(page) AS page FROM roles GROUP BY 1),
        roles1 AS (SELECT r.* FROM roles r SEMI JOIN firstp USING (doc_id, page)),
        amounts1 AS (SELECT a.* FROM amounts a SEMI JOIN firstp USING (doc_id, page)),"""
        + _bounds_cte("roles1", "amounts1"), _BOUNDS_SELECT),
    "inspect_area": _with(WORDS, """SELECT doc_id, CAST(page AS BIGINT) AS page, gy AS line_y,
        string_agg(text, ' ' ORDER BY x0, ord) AS line_text FROM grid WHERE page = 2 AND y0 BETWEEN 240 AND 350 GROUP BY 1, 2, 3"""),
    "deposits": _with(LEDGER, f"""SELECT doc_id, date_raw, description, {_money('d')} AS deposit, {_money('b')} AS balance
        FROM led WHERE d IS NOT NULL"""),
    "large_withdrawals": _with(LEDGER, f"""SELECT doc_id, date_raw, description, {_money('w')} AS withdrawal, {_money('b')} AS balance
        FROM led WHERE w > 10000"""),
    "keyword_search": _with(LEDGER, f"""SELECT doc_id, date_raw, description, {_money('w')} AS withdrawal, {_money('d')} AS deposit,
        {_money('b')} AS balance FROM led WHERE description ILIKE '%paynow%'"""),
    "page_rows": _with(LEDGER, f"SELECT {_LEDGER_COLUMNS} FROM led WHERE page = 2"),
    "head_n": _with(LEDGER, f"""SELECT doc_id, txn_seq, page, date_raw, substr(description, 1, 80) AS description,
        substr(description, 81, 80) AS description_more, substr(description, 1, 60) AS description_short,
        {_DISPLAY('w')} AS withdrawal, {_DISPLAY('d')} AS deposit, {_DISPLAY('b')} AS balance FROM led WHERE txn_seq <= 10"""),
    "ledger_stats": _with(_LED_SUM, f"""SELECT doc_id, n AS n_transactions, nw AS n_withdrawals, nd AS n_deposits,
        {_money('sw')} AS total_withdrawals, {_money('sd')} AS total_deposits, {_money('sd - sw')} AS net_change,
        {_money('ob')} AS opening_balance, {_money('lb')} AS closing_balance, {_money('lb - ob')} AS actual_change,
        {_money('fb')} AS first_balance, {_money('lb - fb')} AS calculated_change,
        {_money('nfb')} AS first_non_forward_balance FROM agg"""),
    "daily_summary": _with(LEDGER, f"""SELECT CAST(txn_date AS VARCHAR) AS txn_date, {_money('coalesce(sum(w), 0)')} AS withdrawal,
        {_money('coalesce(sum(d), 0)')} AS deposit FROM led GROUP BY 1"""),
    "column_profile": _with(LEDGER, """SELECT c.column_name, c.data_type, count(*) AS n_rows,
        sum(CASE c.column_name WHEN 'withdrawal' THEN CASE WHEN w IS NULL THEN 0 ELSE 1 END
              WHEN 'deposit' THEN CASE WHEN d IS NULL THEN 0 ELSE 1 END
              WHEN 'balance' THEN CASE WHEN b IS NULL THEN 0 ELSE 1 END ELSE 1 END)::BIGINT AS n_present
        FROM led, (VALUES ('doc_id', 'bigint'), ('page', 'int'), ('txn_seq', 'bigint'), ('date_raw', 'string'),
          ('txn_date', 'date'), ('description', 'string'), ('withdrawal', 'decimal(18,2)'), ('deposit', 'decimal(18,2)'),
          ('balance', 'decimal(18,2)')) c(column_name, data_type) GROUP BY 1, 2"""),
    "balance_continuity": _with(_LED_CONT, f"""SELECT doc_id, txn_seq, {_money('expected')} AS expected, {_money('b')} AS balance,
        {_money('diff')} AS difference, status FROM checked"""),
    "discrepancies": _with(_LED_CONT, f"""SELECT doc_id, txn_seq - 1 AS "index", date_raw AS "date", {_money('expected')} AS expected,
        {_money('b')} AS actual, {_money('diff')} AS difference FROM checked WHERE status = 'BREAK'"""),
    "running_balance": _with(LEDGER + """,
        opening AS (SELECT doc_id, b + coalesce(w, 0) - coalesce(d, 0) AS ob FROM led WHERE txn_seq = 1)""",
        f"""SELECT led.doc_id, txn_seq, {_money('''(ob + sum(coalesce(d, 0) - coalesce(w, 0)) OVER
          (PARTITION BY led.doc_id ORDER BY txn_seq ROWS UNBOUNDED PRECEDING))''')} AS running_balance
        FROM led JOIN opening ON opening.doc_id = led.doc_id"""),
    "date_order": _with(LEDGER + """,
        moved AS (SELECT *, CAST(CASE WHEN okey % 61 = 0 THEN txn_date - INTERVAL 400 DAY ELSE txn_date END AS DATE) AS dt FROM led)""",
        """SELECT doc_id, txn_seq, CAST(dt AS VARCHAR) AS txn_date,
        coalesce(dt < lag(dt) OVER (PARTITION BY doc_id ORDER BY txn_seq), FALSE) AS goes_back FROM moved"""),
    "duplicates": _with(_RESCANNED, f"""SELECT doc_id, date_raw, description, {_money('w')} AS withdrawal, {_money('d')} AS deposit,
        {_money('b')} AS balance, count(*) AS copies, min(txn_seq) AS first_seq FROM twice
        GROUP BY doc_id, date_raw, description, w, d, b HAVING count(*) > 1"""),
    "first_occurrences": _with(_RESCANNED, f"""SELECT doc_id, txn_seq, description, {_money('b')} AS balance FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, date_raw, description, w, d, b ORDER BY txn_seq) AS r FROM twice) WHERE r = 1"""),
    "golden_compare": _with(PARSED, """SELECT g.doc_id, g.txn_seq, p.doc_id IS NOT NULL AS found,
        p.doc_id IS NOT NULL AND pw IS NOT DISTINCT FROM (g.w + CASE WHEN g.okey % 29 = 0 THEN 100 ELSE 0 END) AS withdrawal_ok,
        p.doc_id IS NOT NULL AND pd IS NOT DISTINCT FROM g.d AS deposit_ok,
        p.doc_id IS NOT NULL AND abs(coalesce(pb, 0) - coalesce(g.b, 0)) < 1 AS balance_ok,
        p.doc_id IS NOT NULL AND g.okey % 31 <> 0 AS description_ok
        FROM led g LEFT JOIN parsed p ON g.doc_id = p.doc_id AND g.txn_seq = p.txn_seq WHERE g.txn_seq <= 5"""),
    "closing_check": _with(LEDGER + """,
        last AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY txn_seq DESC) = 1)""",
        f"""SELECT doc_id, {_money('b')} AS last_balance, {_money('2000000000 + run')} AS closing, {_money('run')} AS expected_change,
        CASE WHEN b IS NULL THEN 'UNVERIFIABLE' WHEN abs(b - 2000000000 - run) < 1 THEN 'OK' ELSE 'MISMATCH' END AS status FROM last"""),
    "field_rules": _with(LEDGER, """SELECT doc_id, txn_seq, concat_ws('; ', CASE WHEN okey % 73 = 0 THEN 'date' END,
        CASE WHEN b IS NULL THEN 'balance' END) AS missing_fields, okey % 73 <> 0 AND okey % 71 <> 0 AS date_valid,
        (w IS NOT NULL) <> (d IS NOT NULL) AS one_side FROM led"""),
    "currencies": _with(WORDS, "SELECT DISTINCT doc_id, 'SGD' AS currency, CAST(1 AS BIGINT) AS n_currencies FROM shown"),
    "conflicting_totals": _with(WORDS + f""",
        tot AS (SELECT DISTINCT doc_id, {_FOOT_TOTAL} AS t FROM shown WHERE doc_id % 2 = 0)""",
        f"""SELECT doc_id, count(*) AS n_totals, {_money('min(t)')} AS least, {_money('max(t)')} AS greatest,
        count(*) > 1 AS conflict FROM tot GROUP BY doc_id"""),
    "page_anomalies": _with(WORDS, """SELECT doc_id, CAST(3 AS BIGINT) AS page, 'missing' AS anomaly, CAST(0 AS BIGINT) AS copies
          FROM docs WHERE doc_id % 51 = 0 AND n_pages >= 3
        UNION ALL SELECT DISTINCT doc_id, 90, 'surplus', 1 FROM shown WHERE page = 2 AND doc_id % 17 = 0
        UNION ALL SELECT DISTINCT doc_id, 2, 'repeated', 2 FROM shown WHERE page = 2 AND doc_id % 17 = 0"""),
    "decisions": _with(_PARSED_CONT, """SELECT r.doc_id, confidence, coalesce(n_breaks, 0) AS n_breaks,
        coalesce(n_unverifiable, 0) AS n_unverifiable, coalesce(n_one_side, 0) AS n_one_side,
        CASE WHEN NOT success OR coalesce(n_breaks + n_unverifiable + n_one_side, 0) > 0 THEN 'review' WHEN confidence >= 0.8 THEN 'approve'
             WHEN confidence >= 0.5 THEN 'review' ELSE 'reject' END AS decision
        FROM results r LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE status = 'BREAK') AS n_breaks,
          count(*) FILTER (WHERE status = 'UNVERIFIABLE') AS n_unverifiable,
          count(*) FILTER (WHERE (pw IS NULL) = (pd IS NULL)) AS n_one_side FROM checked GROUP BY 1) c
          ON c.doc_id = r.doc_id"""),
    "corrections": _with(_CORRECTED, f"""SELECT doc_id, txn_seq, nt AS description, {_money('nw')} AS withdrawal,
        {_money('d')} AS deposit, {_money('nb')} AS balance FROM fixed"""),
    "correction_audit": _with(_CORRECTED, f"""
        SELECT doc_id, txn_seq, 'withdrawal' AS field, {_plain('w')} AS old_value, {_plain('nw')} AS new_value,
               CAST(CASE WHEN okey % 82 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version
          FROM fixed WHERE okey % 41 = 0 AND w IS DISTINCT FROM nw
        UNION ALL SELECT doc_id, txn_seq, 'description', description, nt, 1 FROM fixed WHERE okey % 43 = 0
        UNION ALL SELECT doc_id, txn_seq, 'balance', {_plain('b')}, NULL, 1 FROM fixed WHERE okey % 47 = 0 AND b IS NOT NULL"""),
    "correction_history": _with(LEDGER + """,
        every AS (SELECT *, unnest([
          {'n': 41, 'field': 'withdrawal', 'value': '12.34', 'version': 1}, {'n': 82, 'field': 'withdrawal', 'value': '56.78', 'version': 2},
          {'n': 43, 'field': 'description', 'value': 'CORRECTED', 'version': 1}, {'n': 47, 'field': 'balance', 'value': NULL, 'version': 1},
          {'n': 123, 'field': 'withdrawal', 'value': '12,34x', 'version': 3}, {'n': 53, 'field': 'payee', 'value': 'X', 'version': 1}]) AS e FROM led)""",
        """SELECT doc_id, txn_seq, e.field AS field, e.value AS value, CAST(e.version AS BIGINT) AS version,
        CASE WHEN okey % 19 = 0 THEN 'orphaned' WHEN e.n IN (123, 53) THEN 'rejected'
             WHEN e.n = 41 AND okey % 82 = 0 THEN 'superseded' ELSE 'applied' END AS outcome
        FROM every WHERE okey % e.n = 0"""),
    "ledger_as_of": _with(LEDGER, f"""SELECT doc_id, txn_seq, v AS as_of, CASE WHEN v >= 1 AND okey % 43 = 0 THEN 'CORRECTED' ELSE description END AS description,
        {_money("CASE WHEN v >= 2 AND okey % 82 = 0 THEN 5678 WHEN v >= 1 AND okey % 41 = 0 THEN 1234 ELSE w END")} AS withdrawal, {_money('d')} AS deposit,
        {_money("CASE WHEN v >= 1 AND okey % 47 = 0 THEN NULL ELSE b END")} AS balance FROM led, range(3) AS r(v)"""),
    "correction_intervals": _with(LEDGER + f""",
        entries AS (SELECT doc_id, txn_seq, unnest(list_concat(
            CASE WHEN okey % 41 = 0 THEN [{{'f': 'withdrawal', 'x': {_plain('w')}, 'a': NULL, 'b': 1}}] ELSE [] END,
            CASE WHEN okey % 41 = 0 THEN [{{'f': 'withdrawal', 'x': '12.34', 'a': 1, 'b': CASE WHEN okey % 82 = 0 THEN 2 END}}] ELSE [] END,
            CASE WHEN okey % 82 = 0 THEN [{{'f': 'withdrawal', 'x': '56.78', 'a': 2, 'b': NULL}}] ELSE [] END,
            CASE WHEN okey % 43 = 0 THEN [{{'f': 'description', 'x': description, 'a': NULL, 'b': 1}}, {{'f': 'description', 'x': 'CORRECTED', 'a': 1, 'b': NULL}}] ELSE [] END,
            CASE WHEN okey % 47 = 0 THEN [{{'f': 'balance', 'x': {_plain('b')}, 'a': NULL, 'b': 1}}, {{'f': 'balance', 'x': NULL, 'a': 1, 'b': NULL}}] ELSE [] END)) AS e FROM led)""",
        "SELECT doc_id, txn_seq, e.f AS field, e.x AS value, e.a::BIGINT AS from_version, e.b::BIGINT AS to_version FROM entries"),
    "inferred_sides": _with(LEDGER + """,
        seen AS (SELECT *, coalesce(w, d) AS a, b - lag(b) OVER (PARTITION BY doc_id ORDER BY txn_seq) AS step FROM led),
        told AS (SELECT *, CASE WHEN contains(description, 'ATM') THEN 'out' WHEN contains(description, 'SALARY') THEN 'in'
                               WHEN step < 0 THEN 'out' WHEN step > 0 THEN 'in' END AS side,
                           CASE WHEN contains(description, 'ATM') OR contains(description, 'SALARY') THEN 'keyword' WHEN step <> 0 THEN 'balance' ELSE 'none' END AS src FROM seen)""",
        f"""SELECT doc_id, txn_seq, {_money("CASE WHEN doc_id % 2 = 1 THEN w WHEN side = 'out' AND a <> 0 THEN a END")} AS withdrawal,
        {_money("CASE WHEN doc_id % 2 = 1 THEN d WHEN side = 'in' AND a <> 0 THEN a END")} AS deposit,
        {_money("CASE WHEN doc_id % 2 = 0 AND side IS NULL AND a <> 0 THEN a END")} AS unplaced,
        CASE WHEN doc_id % 2 = 0 AND a <> 0 THEN src END AS side_source FROM told"""),
    "filtered_checks": _with(_RESCANNED + """,
        rest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, date_raw, description, w, d, b ORDER BY txn_seq) AS copy FROM twice)
          WHERE copy = 1 AND okey % 7 <> 0),
        seen AS (SELECT *, lag(b) OVER o AS pb0, row_number() OVER o AS n, lag(txn_date) OVER o AS before,
          first_value(b) OVER o AS fb, sum(coalesce(d, 0) - coalesce(w, 0)) OVER o AS moved,
          first_value(coalesce(d, 0) - coalesce(w, 0)) OVER o AS first_move
          FROM rest WINDOW o AS (PARTITION BY doc_id ORDER BY txn_seq ROWS UNBOUNDED PRECEDING))""",
        f"""SELECT doc_id, txn_seq, {_money('b - pb0 + coalesce(w, 0) - coalesce(d, 0)')} AS difference,
        CASE WHEN n = 1 THEN 'FIRST' WHEN b IS NULL OR pb0 IS NULL THEN 'UNVERIFIABLE'
             WHEN abs(b - pb0 + coalesce(w, 0) - coalesce(d, 0)) > 1 THEN 'BREAK' ELSE 'OK' END AS status,
        {_money('fb + moved - first_move')} AS running_balance, coalesce(txn_date < before, FALSE) AS goes_back FROM seen"""),
    "result_json": _with(PARSED, f"SELECT {_PARSED_COLUMNS} FROM parsed"),
    "export_formats": _with(LEDGER, f"""SELECT {_LEDGER_COLUMNS}, f.format
        FROM led, (VALUES ('csv'), ('parquet')) f(format)"""),
    "stream_intake": _with(PARSED, f"SELECT {_PARSED_COLUMNS} FROM parsed"),
}
