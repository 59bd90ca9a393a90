import random
import re

from thalweg.llm import quotes as Q


def runs(lines):
    """Passages: (level, normalised lines) of the longest runs of written lines of one level."""
    out, last = [], None
    for lv, s in lines:
        s = re.sub(r"\s+", " ", s).strip().lower()
        if s and last == lv:
            out[-1][1].append(s)
        elif s:
            out.append((lv, [s]))
        last = lv if s else None
    return out


def brute(rows):
    """conv -> reply-ordered [(turn, reply_to turn, text)] by a plain walk of the tree."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x or ""))
    out = {}
    for c, ms in by.items():
        ms.sort(key=lambda m: (m[0], m[1], m[2]))
        own, texts, parents = {}, [], []
        for k, (_, _, x) in enumerate(ms):
            lines = []
            for line in re.split(r"\r?\n", x):
                m = re.match(Q.MARK, line)
                lines.append((m[0].count(">") if m else 0, line[m.end():] if m else line))
            texts.append("\n".join(s for i, (lv, s) in enumerate(lines) if lv == 0 and not (re.search(Q.INTRODUCES, s.strip()) and i + 1 < len(lines) and lines[i + 1][0])).strip())
            votes = {}
            ps = runs(lines)
            for lv, ls in ps:
                whole = own.get(" ".join(ls)) if lv else None
                for s in ls if lv else ():
                    at = own.get(s) if whole is None else whole
                    if at is not None:
                        best = votes.setdefault(at, [99, 0])
                        best[0] = min(best[0], lv)
                        best[1] += 1
            parents.append(max(votes, key=lambda p: (-votes[p][0], votes[p][1], p)) if votes else k - 1 if k else None)
            for lv, ls in ps:
                for s in [" ".join(ls), *ls] if lv == 0 else ():
                    own.setdefault(s, k)
        kids = {}
        for k, p in enumerate(parents):
            kids.setdefault(p, []).append(k)
        order, stack = [], list(reversed(kids[None]))
        while stack:
            k = stack.pop()
            order.append((ms[k][0], None if parents[k] is None else ms[parents[k]][0], texts[k]))
            stack += reversed(kids.get(k, []))
        out[c] = order
    return out


def check(spark, rows):
    got = {}
    for r in Q.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, []).append((r.reply_order, r.turn, r.reply_to, r.text))
    want = brute(rows)
    assert set(got) == set(want)
    for c in want:
        assert [x[1:] for x in sorted(got[c])] == want[c], c
        assert [x[0] for x in sorted(got[c])] == list(range(1, len(want[c]) + 1))


def test_nested_quotes_by_hand(spark):
    rows = [(1, 0, "user", "Shall we meet?\nNoon is fine."), (1, 1, "assistant", "Maybe on Monday."), (1, 2, "user", "Other  matter entirely."),
            (1, 3, "user", "On Monday X wrote:\n> maybe on  MONDAY.\n>> Shall we meet?\nYes."), (1, 4, "assistant", "> Other matter entirely.\nSure."), (1, 5, "user", ">> Shall we meet?\nlate")]
    check(spark, rows)
    got = {r.turn: r for r in Q.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[3].reply_to == 1 and got[3].text == "Yes." and (got[3].n_quoted, got[3].n_linked) == (2, 2)
    assert got[4].reply_to == 2 and got[5].reply_to == 0


def test_random_conversations_equal_brute_force(spark):
    r = random.Random(7)
    rows = []
    for c in range(12):
        said = []
        for t in range(r.randint(1, 14)):
            lines = [f"line {r.randint(0, 40)} of talk" for _ in range(r.randint(0, 2))]
            for _ in range(r.randint(0, 2)):
                if said and r.random() < 0.6:
                    lines.insert(0, "> " * r.randint(1, 2) + r.choice(said))
            said += [x for x in lines if x[0] != ">"]
            rows.append((c, t, "user", "\n".join(lines)))
    check(spark, rows)


def test_other_conversations_and_edges(spark):
    rows = [(1, 0, "user", "A line that only one conversation wrote"), (2, 0, "user", "> a line that only one conversation wrote\nindeed"), (3, 0, "user", None), (3, 0, "user", None), (None, None, None, ""), (4, 2, "a", "x"), (4, 1, "a", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Q.ordered(df).collect()
    assert len(got) == len(rows)
    assert [r.source_conv_id for r in got if r.conv_id == 2] == [1] and [r.text for r in got if r.conv_id == 2] == ["indeed"]
    assert [r.turn for r in sorted(got, key=lambda r: r.reply_order) if r.conv_id == 4] == [1, 2]
    assert Q.ordered(df.limit(0)).count() == 0


def test_sources_among_all_conversations_that_wrote_the_lines(spark):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(3):
            lines = {f"line {int(r.paretovariate(0.6)) % 25}" for _ in range(r.randint(1, 4))}
            quoted = [f"> line {int(r.paretovariate(0.6)) % 30}" for _ in range(r.randint(0, 4))]
            rows.append((c, t, "user", "\n".join(quoted + sorted(lines))))
    rows += [(40 + c, t, w, x) for c in range(5) for _, t, w, x in rows[:3]]  # copies
    own, want = {}, {}
    for c, t, _, x in rows:
        mine = [line for line in x.split("\n") if line[0] != ">"]
        for unit in [" ".join(mine), *mine]:
            own.setdefault(c, {}).setdefault(unit, t)
    for c, t, _, x in rows:
        quoted = [line[2:] for line in x.split("\n") if line[0] == ">"]
        whole = " ".join(quoted)
        far = [] if own[c].get(whole, 9) < t else [(q, 1) for q in quoted if own[c].get(q, 9) >= t]
        if quoted and len(far) == len(quoted) and any(whole in own[o] for o in own if o != c):
            far = [(whole, len(quoted))]
        votes = {o: sum(n for q, n in far if q in own[o]) for o in own if o != c}
        top = max(votes.values())
        linked = len(quoted) - sum(n for _, n in far) + sum(n for q, n in far if any(q in own[o] for o in own if o != c))
        want[c, t] = (len(quoted), linked, min(o for o in votes if votes[o] == top) if top else None)
    got = Q.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(x.conv_id, x.turn): (x.n_quoted, x.n_linked, x.source_conv_id) for x in got} == want


def test_quotations_wrapped_anew_and_long_introductions(spark):
    said = "The committee met on the first of May and\nagreed that the bridge should be closed\nuntil the piers are sound again."
    wrapped = "> The committee met on the first\n> of May and agreed that the bridge should\n> be closed until the piers are sound   again."
    rows = [(1, 0, "u", said + "\n\nThanks"), (1, 1, "u", "Thanks"), (1, 2, "u", "On Monday " + "someone of the board " * 40 + "wrote:\n" + wrapped + "\nAgreed."), (2, 0, "u", wrapped + "\n>\n> nobody wrote that\nWho says so?")]
    got = {(r.conv_id, r.turn): r for r in Q.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2].reply_to == 0 and got[1, 2].text == "Agreed." and (got[1, 2].n_quoted, got[1, 2].n_linked) == (3, 3)
    assert got[2, 0].source_conv_id == 1 and (got[2, 0].n_quoted, got[2, 0].n_linked) == (4, 3) and got[2, 0].text == "Who says so?"


def test_very_long_texts_and_clashing_columns(spark):
    long = "\n".join(f"line {k} " + "of a long talk " * 30 for k in range(3000))
    rows = [(1, 0, "u", long, 5), (1, 1, "u", "\n".join("> " + x for x in long.split("\n")[:1000]) + "\nyes", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos long").withColumn("lines", __import__("pyspark").sql.functions.lit(1))
    got = {r.turn: r for r in Q.ordered(df).collect()}
    assert got[1].reply_to == 0 and (got[1].n_quoted, got[1].n_linked) == (1000, 1000) and got[1].text == "yes" and got[0].text == long.strip()


def test_long_conversations_are_ranked_by_ranges(spark, monkeypatch):
    from thalweg.llm import common

    r = random.Random(11)
    rows = []
    for c, n in ((1, 90), (2, 3), (3, 41), (None, 30)):
        said = []
        for t in range(n):
            lines = [f"line {c} {r.randint(0, 60)} of talk" for _ in range(r.randint(0, 2))]
            if said and r.random() < 0.3:
                lines.insert(0, "> " + r.choice(said))
            said += [x for x in lines if x[0] != ">"]
            rows.append((c, t if t % 9 else 0, "user" + str(t % 4), "\n".join(lines)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(repr, Q.ordered(df).collect()))
    monkeypatch.setattr(common, "GROUP_ROWS", 10)
    assert sorted(map(repr, Q.ordered(df.repartition(3)).collect())) == whole and len(whole) == len(rows)


def test_sets_that_share_common_lines_meet_kinds_not_conversations(spark, monkeypatch):
    """n writers of two common lines, n others that quote both with lines between: rows in proportion to n."""
    from thalweg.llm import quotes as Q

    monkeypatch.setattr(Q, "COMMON", 5)
    made = []
    inner = Q.Scratch.keep

    def keep(self, df, name):
        out = inner(self, df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(Q.Scratch, "keep", keep)
    n = 60
    rows = [(i, 0, "a", f"thanks\nhi\nown line {i}") for i in range(n)]
    rows += [(1000 + i, 0, "a", f"> thanks\n> a foreign line {i}\n> hi\nreply") for i in range(n)]
    rows += [(2000, 0, "a", "> thanks\n> own line 7\n> hi\nyes"), (2001, 0, "a", "> own line 9\n> something else\n> hi\nyes")]
    got = {r.conv_id: r.source_conv_id for r in Q.ordered(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).filter("n_quoted > 0").collect()}
    assert all(got[1000 + i] == 0 for i in range(n)) and got[2000] == 7 and got[2001] == 9
    assert max(c for _, c in made) < 12 * n
