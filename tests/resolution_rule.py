"""What must hold of any right resolution of duplicates, stated row by row. For small inputs."""

from collections import deque

from vacancia import fixed_values as V
from vacancia.functions import keys as K


def longest_shared(a, b):
    """Length of the longest common subsequence."""
    lengths = [0] * (len(b) + 1)
    for x in a:
        longer = [0]
        for j, y in enumerate(b):
            longer.append(lengths[j] + 1 if x == y else max(lengths[j + 1], longer[-1]))
        lengths = longer
    return lengths[-1]


def alike(a, b, per_cent):
    """What both share makes up at least so much of their lengths."""
    return 200 * longest_shared(a, b) >= per_cent * (len(a) + len(b))


def rightful_leader(seq, keyed, heads, fuzzy):
    """The leader a row must have: an earlier one by URL, else by key, else by likeness, else itself.

    ``keyed`` is {seq: row with norm_url, norm_title, norm_company, dup_key}, ``heads`` all leaders.
    """
    row = keyed[seq]
    earlier = sorted(h for h in heads if h < seq)

    def ordered(title):
        return " ".join(sorted(title.split()))

    def similar(other):
        return alike(row["norm_company"], other["norm_company"], V.COMPANY_SIMILARITY) and alike(
            ordered(row["norm_title"]), ordered(other["norm_title"]), V.TITLE_SIMILARITY
        )

    tests = [lambda other: row["norm_url"] and other["norm_url"] == row["norm_url"]]
    tests.append(lambda other: row["dup_key"] and other["dup_key"] == row["dup_key"])
    if fuzzy:
        tests.append(lambda other: row["dup_key"] and other["dup_key"] and similar(other))
    for test in tests:
        for head in earlier:
            if test(keyed[head]):
                return head
    return seq


def wrong_leaders(keyed, leaders, fuzzy):
    """Rows of {seq: leader} that do not follow the rule."""
    heads = {seq for seq, leader in leaders.items() if seq == leader}
    return [seq for seq in keyed if leaders[seq] != rightful_leader(seq, keyed, heads, fuzzy)]


def filled(value):
    return value is not None and value != ""


def parts(rows):
    return sorted({p.strip() for r in rows if r["source"] for p in r["source"].split(V.SOURCE_SEPARATOR)})


def worth(rows):
    """Weights of all that any of the rows has."""
    total = sum(w for name, w in K.TEXT_WEIGHTS.items() if any(filled(r[name]) for r in rows))
    total += sum(w for name, w in K.VALUE_WEIGHTS.items() if any(r[name] is not None for r in rows))
    longest = max(len(r["description"] or "") for r in rows)
    return total + sum(w for bound, w in K.LONG_DESCRIPTION if longest > bound)


def of_platform(rows):
    return any(filled(r["ats_platform"]) for r in rows) or V.SOURCE_SEPARATOR.join(parts(rows)) in V.ATS_SOURCES


def in_order(group):
    """A group's rows, foremost first: a row goes to the front if it beats all before it together."""
    order = deque()
    for n, row in enumerate(group):
        before = group[:n]
        ahead = n and (of_platform([row]), worth([row])) > (of_platform(before), worth(before))
        order.appendleft(row) if ahead else order.append(row)
    return order


def merged(group, fields):
    """The row that must come out of a group in ``seq`` order."""
    if len(group) == 1:
        return {name: group[0][name] for name in fields}
    order = in_order(group)
    out = {name: next((r[name] for r in order if filled(r[name])), None) for name in fields}
    out["description"] = max((r["description"] or "" for r in order), key=len) or None
    out["source"] = V.SOURCE_SEPARATOR.join(parts(group)) or None
    return out
