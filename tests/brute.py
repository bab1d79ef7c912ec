"""Level-wise discovery in plain Python, for small tables given as {name: (columns, rows of text)}."""

from collections import Counter
from itertools import product


def discover(tables, threshold=1.0, nulls="subset", aware=True, max_nary=None, null_string=""):
    def key(row, cols):
        values = [row[c] for c in cols]
        if nulls == "equality":
            return tuple(null_string if v is None else v for v in values)
        return None if any(v is None or v == null_string for v in values) else tuple(values)

    def counts(attr):
        found = Counter(key(r, attr[1]) for r in tables[attr[0]][1])
        return found.pop(None, 0), found

    facts = {}

    def fact(attr):
        if attr not in facts:
            facts[attr] = counts(attr)
        return facts[attr]

    def check(d, r):
        (d_null, own), (r_null, other) = fact(d), fact(r)
        size = sum(own.values()) if aware else len(own)
        viol = sum((n if aware else 1) for v, n in own.items() if v not in other)
        if nulls == "inequality":
            viol += d_null
        cap = int((1.0 - threshold) * size)
        return (size, cap, viol) if viol <= cap and not (nulls == "foreign" and r_null) else None

    names = list(tables)
    attrs = [(t, (i,)) for t in names for i in range(len(tables[t][0]))]
    out, valid = [], {}
    for d, r in product(attrs, attrs):
        if d != r and (found := check(d, r)):
            valid[d, r] = found
    unary = [(d, r) for d, r in valid if fact(d)[1] and fact(r)[1]]
    layer = 1
    while valid:
        out += [(layer, d, r, *v) for (d, r), v in valid.items()]
        if layer == max_nary:
            break
        longer = set()
        for d, r in valid:
            if not fact(d)[1]:
                continue
            for (dt, (x,)), (rt, (y,)) in unary:
                if dt != d[0] or rt != r[0] or x <= max(d[1]) or y in r[1]:
                    continue
                if dt == rt and (y in d[1] or x in r[1] or x == y):
                    continue
                dd, rr = (dt, (*d[1], x)), (rt, (*r[1], y))
                drop = lambda a, s: (a[0], a[1][:s] + a[1][s + 1 :])
                if all((drop(dd, s), drop(rr, s)) in valid for s in range(layer)):
                    longer.add((dd, rr))
        valid = {pair: found for pair in longer if (found := check(*pair))}
        layer += 1
    show = lambda a: ",".join(f"{a[0]}.{tables[a[0]][0][c]}" for c in a[1])
    return sorted((k, show(d), show(r), *v) for k, d, r, *v in out)
