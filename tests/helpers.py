"""Small inputs built row by row, and plain-Python versions of the cascade to check against."""


from memsight.sources import tables

# days before each month of the anonymised calendar
BEFORE = {1: 0, 2: 31, 3: 61, 4: 92, 5: 123, 6: 152, 7: 183, 8: 213, 9: 246}


def off(month, day, hour=0, minute=0, second=0):
    return (((BEFORE[month] + day) * 24 + hour) * 60 + minute) * 60 + second


def clock(offset):
    day, rest = divmod(offset, 86400)
    month = max(m for m, b in BEFORE.items() if day > b)
    return f"0001-{month:02d}-{day - BEFORE[month]:02d} {rest // 3600:02d}:{rest % 3600 // 60:02d}:{rest % 60:02d}"


def make_log(spark, rows):
    """Rows of (sid, memoryid, rankid, bankid, row, col, error_type, offset)."""
    raw = spark.createDataFrame([(*r[:7], clock(r[7])) for r in rows], tables.log_schema())
    return tables.error_log(raw)


def make_inventory(spark, rows):
    return spark.createDataFrame(rows, tables.inventory_schema())


def make_tickets(spark, rows):
    """Rows of (sid, offset, failure_type)."""
    raw = spark.createDataFrame([(s, clock(t), k) for s, t, k in rows], tables.ticket_schema())
    return tables.trouble_tickets(raw)


def cascade(rows, min_errors, gap=60):
    """Classes of rows (dicts with socket, channel, dimm, rank, bank, row, col, t), one by one."""
    left = list(range(len(rows)))
    out = [None] * len(rows)

    def key(i, names):
        return tuple(rows[i][n] for n in names)

    def take(names, faulty, label):
        nonlocal left
        groups = {}
        for i in left:
            groups.setdefault(key(i, names), []).append(i)
        hit = {k for k, members in groups.items() if faulty(members)}
        for i in left:
            if key(i, names) in hit:
                out[i] = label
        left = [i for i in left if out[i] is None]

    def many(members, names, limit):
        whole = [i for i in members if None not in key(i, names)]
        return len(whole) > limit and len({key(i, names) for i in whole}) > 1

    bank = ["socket", "channel", "dimm", "rank", "bank"]
    take(["socket"], lambda m: many(m, ["channel"], min_errors), "socket")
    take(["socket", "channel"], lambda m: many(m, ["dimm", "rank", "bank"], min_errors), "channel")
    take(bank, lambda m: many(m, ["row"], min_errors), "bank")
    take([*bank, "row"], lambda m: rows[m[0]]["row"] is not None and many(m, ["col"], 0), "row")
    take([*bank, "col"], lambda m: rows[m[0]]["col"] is not None and many(m, ["row"], 0), "column")
    cells = {}
    for i in left:
        if rows[i]["row"] is not None and rows[i]["col"] is not None:
            cells.setdefault(key(i, [*bank, "row", "col"]), []).append(i)
    for members in cells.values():
        times = sorted(rows[i]["t"] for i in members)
        close = any(b - a <= gap for a, b in zip(times, times[1:]))
        for i in members:
            out[i] = "cell" if close else "random"
    return out


def located(r):
    memory = r[1]
    return {"sid": r[0], "socket": 0 if memory < 12 else 1, "channel": memory % 12 // 2, "dimm": memory % 2,
            "rank": r[2], "bank": r[3], "row": r[4], "col": r[5], "t": r[7]}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


