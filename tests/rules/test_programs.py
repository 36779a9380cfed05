"""Programs and their items; data and rules are small and typed here."""

import pytest

from rulespark.lang.ast import AggregatorConflict, PlanError, RuleSyntaxError, Term
from rulespark.session.program import Program

a, b, c = Term("a"), Term("b"), Term("c")


def items(spark, text, *names, **options):
    p = Program(spark, text, **options)
    return [p.items(n) for n in names]


def test_shortest_path(spark):
    p = Program(spark, """
        path(start) min= 0.  path(B) min= path(A) + edge(A,B).  goal min= path(end).
        edge("p","q") := 3.  edge("q","r") := 4.  edge("p","r") := 9.  edge("r","p") := 1.  edge("x","y") := 1.
        start := "p".  end := "r".""")  # fmt: skip
    assert p.items("path") == {("p",): 0, ("q",): 3, ("r",): 7} and p.value("goal") == 7
    assert p.evaluation.rounds["path/1"] < 6 and p.evaluation.converged


def test_best_choice_is_followed_by_its_key(spark):
    """The tallest tower of narrowing blocks: the key of each block's best height is the block below."""
    p = Program(spark, """
        tall(B) max= H with_key "floor" for block(B,_,H).
        tall(B) max= tall(A) + H with_key A for block(A,V,_), block(B,W,H), W < V.
        top max= tall(B) with_key B.
        level(0,B) := true for B is $key(top).
        level(N+1,A) := true for level(N,B), A is $key(tall(B)), A != "floor".
        block("slab",9,1).  block("cube",5,5).  block("rod",2,8).  block("plate",7,2).  block("post",2,9).""")  # fmt: skip
    assert p.value("top") == 17 and p.keys("tall")[("rod",)] == "cube" and p.keys("tall")[("slab",)] == "floor"
    assert set(p.items("level")) == {(0, "post"), (1, "cube"), (2, "plate"), (3, "slab")}


def test_lists_taken_apart_and_put_together(spark):
    p = Program(spark, """
        :- backchain weave/2.  weave([], L) = L.  weave([H|T], L) = [H|weave(L, T)].
        :- backchain total/1.  total([]) = 0.  total([H|T]) = H + total(T).
        woven = weave([1,3,5,7], ["a","b"]).  long(N) := total(range(N)) for N in [10,400,3000].""")  # fmt: skip
    assert p.value("woven") == (1, "a", 3, "b", 5, 7)
    assert p.items("long") == {(n,): n * (n - 1) // 2 for n in (10, 400, 3000)}  # one goal within another for each element


def test_terms_grow_along_a_hierarchy(spark):
    p = Program(spark, """
        part("bike","wheel").  part("bike","frame").  part("wheel","rim").  part("wheel","spoke").
        whole(X) :- part(X,_).  thing(X) :- part(X,_).  thing(X) :- part(_,X).
        built(X) = &made(X, inside(X)) for whole(X).
        built(X) = &single(X) for thing(X), X != "bike", X != "wheel".
        inside(X) set= built(Y) for part(X,Y).""")  # fmt: skip
    single = lambda x: Term("single", (x,))
    wheel = Term("made", ("wheel", (single("rim"), single("spoke"))))
    assert p.items("built")[("wheel",)] == wheel
    assert set(p.items("inside")[("bike",)]) == {wheel, single("frame")} and p.items("built")[("frame",)] == single("frame")


def test_quoted_arguments(spark):
    """Dispositions: names of units are quoted, so that `m` is itself and not the item m."""
    p = Program(spark, """
        :- dispos rate(&,&).  :- dispos kind(&).
        m := 7.
        rate(km,m) := 1000.  rate(m,mm) := 1000.  rate(h,s) := 3600.
        kind(m) := "length".  kind(s) := "time".
        through(A,C) := rate(A,B) * rate(B,C).  known(K) set= B for _ is rate(_,B), K is kind(B).""")  # fmt: skip
    km, m, mm = Term("km"), Term("m"), Term("mm")
    assert p.items("through") == {(km, mm): 1_000_000}
    assert p.items("known") == {("length",): (m,), ("time",): (Term("s"),)} and p.value("m") == 7


def test_equality_as_a_value_and_as_a_binding(spark):
    p = Program(spark, """
        left(1) := "x".  left(2) := "y".  left(3) := 4.  right(1) := "x".  right(2) := "z".  right(3) := 4.0.
        same(K) := left(K) == right(K).  unified(K) := X = Y for X is left(K), Y is right(K).
        taken(K,V) := true for V is left(K), V == right(K).  told(K) := "yes" for "x" is left(K).""")  # fmt: skip
    assert p.items("same") == {(1,): True, (2,): False, (3,): True} and p.items("unified") == {(1,): True, (3,): True}
    assert set(p.items("taken")) == {(1, "x"), (3, 4)} and p.items("told") == {(1,): "yes"}


def test_backchained_factorial_and_bounded_recursion(spark):
    assert items(spark, ":- backchain f/1.  f(X) := X * f(X-1) for X > 0.  f(0) := 1.  a := f(4).", "a") == [{(): 24}]
    (fib,) = items(spark, "f(1) += 1.  f(2) += 1.  f(X) += f(X-1) + f(X-2) for X < lim.  lim := 10.", "f")
    assert [fib[i,] for i in range(1, 10)] == [1, 1, 2, 3, 5, 8, 13, 21, 34]


def test_series_reaches_its_limit_exactly(spark):
    assert items(spark, "a += 1.  a += a / 2.", "a") == [{(): 2.0}]


def test_existence(spark):
    assert items(spark, "a :- b.  b :- c.  c.", "a", "c") == [{(): True}, {(): True}]


@pytest.mark.parametrize(
    ("rules", "value"),
    [
        ("x += 1.  x += 1.  x += 2.5.", 4.5), ('x += "b".  x += "a".', "ab"), ("x *= 3.  x *= -4.", -12), ("x *= 3.  x *= 0.", 0), ("x *= 0.5.  x *= 4.0.", 2.0),
        ("x min= 3.  x min= 1.5.", 1.5), ('x max= "a".  x max= "b".', "b"), ("x mean= 1.  x mean= 2.", 1.5), ("x majority= 1.  x majority= 2.  x majority= 2.", 2),
        ("x |= false.  x |= true.", True), ("x &= false.  x &= true.", False), ("x set= 2.  x set= 1.  x set= 2.", (1, 2)), ('x bag= 2.  x bag= "a".  x bag= 2.', (2, 2, "a")),
        ("x = 1.  x = 1.", 1), ("x := 1.  x := 2.", 2), ("x := 1.  x := null.", None), ("x majority= &f(1).  x majority= &f(1).  x majority= 3.", Term("f", (1,))),
        ("x max= &pair(1,2).  x max= &pair(1,3).", Term("pair", (1, 3))), ("x max= [1,2].  x max= [1,3].", (1, 3)), ("x set= true.  x set= 1.", (True, 1)),
        ("x min= 5 with_key 2.  x min= 5 with_key 1.", 5), ("x := 1 for 1 < 2.  x := 3 for 2 < 1.", 1), ("x := 1, \"no\".", None), ("x += 1 for X in [1,1,2].", 3),
    ],
)
def test_folds(spark, rules, value):
    got = Program(spark, rules).value("x")
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize(
    ("rules", "kind"),
    [
        ("x = 1.  x = 2.", "AggregatorError"), ("y(1) := 1.  y(2) := 2.  x := y(K).", "AggregatorError"), ("x += null.  x += 1.", "TypeError"), ("x += true.", "TypeError"),
        ("x :- false.", "TypeError"), ("x |= 1.", "TypeError"), ("x := 1 / 0.", "ZeroDivisionError"), ('x := "a" + 1.', "TypeError"), ("x := log(0).", "ValueError"),
        ('x := int("q").', "ValueError"), ('x := "a" & true.', "TypeError"), ("x = 1 for X in 12.", "TypeError"), (":- backchain f/1.  f(X) = f(X-1).  x = f(3).", "RuntimeError"),
        ('x := pycall("unknown", 1).', "NameError"),
    ],
)
def test_errors_are_reported_and_leave_no_value(spark, rules, kind):
    p = Program(spark, rules)
    assert p.value("x") is None
    assert kind in " ".join(r.message for r in p.errors().collect())


def test_one_failing_grounding_does_not_stop_the_others(spark):
    p = Program(spark, "v(0) := 0.  v(2) := 2.  out(K) := 1 / v(K).")
    assert p.items("out") == {(2,): 0.5} and p.errors().count() == 1


def test_patterns_of_terms(spark):
    p = Program(spark, """
        diagonal(X) := true for &at(X,X) in [&at(1,1), &at(1,2), 5, &on(3,3), &at("q","q")].
        wrapped(X) set= K for K in range(3), &box(X) in [&box(K), &bag(K), &box("lid")].
        priced("tea") = 3.  priced("salt") = &free.  priced("ink") = true.
        of(X) := true for priced(X) in [&free, true, 4].""")  # fmt: skip
    assert set(p.items("diagonal")) == {(1,), ("q",)} and set(p.items("of")) == {("salt",), ("ink",)}
    assert p.items("wrapped") == {(0,): (0,), (1,): (1,), (2,): (2,), ("lid",): (0, 1, 2)}


def test_patterns_of_lists(spark):
    p = Program(spark, """
        heads(H) += 1 for [H|_] in [[4,1],[4],[],[6,6,6],"no list"].
        after(T) := true for [6|T] in [[6,6],[6],[4,6]].
        stored([2,3]) := 1.  stored([2]) := 5.  stored([9,9]) := 7.  rest(T) += stored([2|T]).
        code(V) := K for (K -> V) in ["one" -> 1, "two" -> 2].
        first(A) := B for [A,B] in [split("red blue"), split("green"), split("grey black")].
        pair(X) := [X|["end"]] for X in range(4), mod(X,2) == 0.
        kept set= X for X in [4,[1],4,"s"].  inside(X) := X in kept for X in [4,"t",[1]].""")  # fmt: skip
    assert p.items("heads") == {(4,): 2, (6,): 1} and set(p.items("after")) == {((6,),), ((),)}
    assert p.items("rest") == {((3,),): 1, ((),): 5} and p.items("code") == {(1,): "one", (2,): "two"}
    assert p.items("first") == {("red",): "blue", ("grey",): "black"} and p.items("pair") == {(0,): (0, "end"), (2,): (2, "end")}
    assert p.items("inside") == {(4,): True, ("t",): False, ((1,),): True}


def test_goals_over_pairs(spark):
    """Run-length decoding: pairs in patterns, a count that runs down, a later rule that overrides."""
    p = Program(spark, """
        :- backchain spread/1.  spread([]) = [].  spread([(N -> X)|R]) = times(N, X, spread(R)).
        :- backchain times/3.  times(0,_,R) = R.  times(N,X,R) = [X|times(N-1,X,R)] for N > 0.
        :- backchain most/1.  most([]) := null.  most([(_ -> X)|_]) := X.  most([(9 -> _)|R]) := most(R).
        short = [2 -> "a", 0 -> "b", 3 -> "c"].""")  # fmt: skip
    assert p.answers("spread(short)") == [({}, ("a", "a", "c", "c", "c"))] and p.answers("spread([])") == [({}, ())]
    assert p.answers("most(short)") == [({}, "a")] and p.answers("most([])") == []
    assert p.answers('most([9 -> "x", 1 -> "y"])') == [({}, "y")]


def test_keys_follow_their_values(spark):
    p = Program(spark, 'x max= 5 with_key "five".  x max= 10 with_key "ten".')
    assert (p.value("x"), p.keys("x/0")) == (10, {(): "ten"})
    p.retract(1)
    assert (p.value("x"), p.keys("x/0")) == (5, {(): "five"})
    p.add("x max= 100.")
    assert (p.value("x"), p.keys("x/0")) == (100, {})


def test_queries(spark):
    p = Program(spark, 'f("a") = 3.0.  f("i") = 1.  f("t") = true.  g(1,"u") += 2.  g(2,"v") += 3.')
    assert p.answers('3 is f("a")') == [({}, True)]
    assert [x for x in p.answers("f(X) == true") if x[1]] == [({"X": "t"}, True)]
    assert sorted(p.answers("g(X,Y)"), key=str) == [({"X": 1, "Y": "u"}, 2), ({"X": 2, "Y": "v"}, 3)]
    assert p.answers("missing(X)") == [] and p.answers("g(X,_) * 2 for X > 1") == [({"X": 2}, 6)]
    frame = p.query("g(X,Y)")
    assert frame.columns == ["X", "Y", "value"] and dict(frame.dtypes)["value"] == "bigint"


def test_bindings_as_a_value(spark):
    p = Program(spark, 'f("a") := 1.  f("b") := 2.  all dict= f(X) * 10 for f(X) > 0.  by(V) dict= X for V is f(X).')
    pair = lambda k, v: Term("->", (k, v))
    assert p.value("all") == ((pair("X", "a"), pair("$val", 10)), (pair("X", "b"), pair("$val", 20)))
    assert p.items("by")[(2,)] == ((pair("V", 2), pair("X", "b"), pair("$val", "b")),)


def test_refused_programs_change_nothing(spark):
    p = Program(spark, "x += 1.")
    for text, error in [("x max= 2.", AggregatorConflict), ("y(Z) += 1.", PlanError), ("y += ", RuleSyntaxError), ("z := q(A) + B.", PlanError)]:
        with pytest.raises(error):
            p.add(text)
    assert p.value("x") == 1 and list(p.rules) == [0]
    with pytest.raises(KeyError):
        p.retract(9)


def test_retraction_and_changes(spark):
    p = Program(spark, "x += 1.  x += 2.  y(K) += x * K for K in [1,2].")
    assert p.retract(0).items() == {"x": 2, "y(1)": 2, "y(2)": 4}
    assert p.add("x += 10.").items() == {"x": 12, "y(1)": 12, "y(2)": 24}
    p.retract(1)
    assert p.retract(3).items() == {"x": None, "y(1)": None, "y(2)": None}
    p.add("x max= 3.")  # the aggregator went with the last rule
    assert p.items("y") == {(1,): 3, (2,): 6}


def test_retraction_in_a_cycle_ends(spark):
    p = Program(spark, 'd(X) min= 0 for X is start.  d(Y) min= d(X) + e(X,Y).  start := "a".  e("a","b") := 1.  e("b","c") := 1.  e("c","b") := 1.')
    assert p.items("d") == {("a",): 0, ("b",): 1, ("c",): 2}
    p.retract(3)
    assert p.items("d") == {("a",): 0}


def test_endless_programs_stop(spark):
    p = Program(spark, "f(0) := 0.  f(X) := X for X is f(Y) + 1.", max_rounds=5)
    assert len(p.items("f")) >= 4 and p.evaluation.converged is False


def test_late_backchaining(spark):
    p = Program(spark, "x(X) = f(X) for X in range(1,4).  y(X) += g(X).")
    assert p.items("x") == {}
    p.add(":- backchain f/1.  f(X) = X.")
    assert p.items("x") == {(1,): 1, (2,): 2, (3,): 3}
    p.add(":- backchain g/1.  g(X) = X + 1.")
    assert [r.index for r, _ in p.compiled.unplanned] == [1]
    p.add(":- backchain y/1.")
    assert p.compiled.unplanned == [] and p.answers("y(3)") == [({}, 4)]


def test_memos_follow_added_and_retracted_rules(spark):
    p = Program(spark, ":- backchain f/1.  f(X) += X.  s += f(Y) for Y in [1,2].")
    assert p.value("s") == 3
    p.add("f(X) += 10.")
    assert p.value("s") == 23
    p.retract(0)
    assert p.value("s") == 20


def test_defaults_ratio_and_theta(spark):
    p = Program(spark, """
        at("a",0).  at("a",1).  at("b",2).  at("c",3).
        n(W) += 1 for at(W,_).  total += n(W).  kinds += 1 for n(W) > 0.  share(W) := n(W) / total.
        next(U,V) += 1 for at(U,T), at(V,T+1).  chance *= at(U,T), at(V,T+1), next(U,V) / n(U).
        later(T,S) :- T < S, at(_,T), at(_,S).  count += 1 for later(_,_).
        z(K) += 0 for _ is n(K).  z(K) += 5 for n(K) > 1.""")  # fmt: skip
    assert p.items("share") == {("a",): 0.5, ("b",): 0.25, ("c",): 0.25} and p.value("kinds") == 3
    assert p.items("next") == {("a", "a"): 1, ("a", "b"): 1, ("b", "c"): 1} and p.value("chance") == 0.25
    assert p.value("count") == 6 and p.items("z") == {("a",): 5, ("b",): 0, ("c",): 0}


def test_self_join_counts_the_diagonal_once(spark):
    assert items(spark, "b(1) := 2.  b(2) := 3.  x += b(I) * b(J).  y += b(I) * b(I).", "x", "y") == [{(): 25}, {(): 13}]


def test_registered_functions(spark):
    p = Program(spark)
    p.register("twice", lambda v: v * 2, "long")
    p.add('x := pycall("twice", 4).  y(K) := twice(K) for K in [1,2].  z := pycall("twice", "a").')
    assert p.value("x") == 8 and p.items("y") == {(1,): 2, (2,): 4}
    p.register("twice", lambda v: v * 20, "long")
    assert p.value("x") == 80


def test_bound_frames(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (2, None, 4.0), (3, "y", None)], "k int, s string, v double")
    p = Program(spark, "n(S) += V for bagged(_,S,V).  u(K) := folded(K,S).")
    p.bind("bagged", df, ["k", "s", "v"], bag=True)
    p.bind("folded", df.where("k = 1"), ["k", "s"], "v", aggregator="+=")
    assert p.items("n") == {("x",): 5.0} and p.items("u") == {(1,): 5.0}
    p.insert("bagged", spark.createDataFrame([(9, "y", 1.0)], "k int, s string, v double"))
    assert p.items("n") == {("x",): 5.0, ("y",): 1.0}
    assert "Aggregate" not in p.relation("bagged")._jdf.queryExecution().optimizedPlan().toString()


def test_rules_win_over_loaded_rows(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    p = Program(spark, "m(1) := 99.")
    p.bind("m", df, ["k"], "v", aggregator=":=")
    assert p.items("m") == {(1,): 99, (2,): 20}


def test_save_and_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "k long, v double")
    p = Program(spark, "x(K) := V for V is d(K).  y := 1.  y := 2.")
    p.bind("d", df, ["k"], "v", unique=True)
    p.retract(1)
    p.save(str(tmp_path / "s"))
    q = Program.restore(spark, str(tmp_path / "s"))
    assert q.items("x") == {(1,): 2.5} and q.value("y") == 2 and list(q.rules) == [0, 2]


def test_saved_terms_pragmas_and_functions(spark, tmp_path):
    (tmp_path / "t.lisp").write_text('(S (NP a) "b")')
    p = Program(spark, "before(X) := g(X) for X in [1].")
    p.load(f'tree = sexpr("{tmp_path}/t.lisp")')
    p.register("twice", lambda v: v * 2, "long")
    p.add(":- dispos g(&).  g(X) := 5 for X in [1].  after(X) := &g(X) for X in [1].  two := twice(4).")
    want = (p.items("tree"), p.items("before"), p.items("after"))
    p.save(str(tmp_path / "s"))
    q = Program.restore(spark, str(tmp_path / "s"), {"twice": lambda v: v * 2})
    assert q.items("tree") == {(0,): ("S", ("NP", "a"), "b")} and (q.items("tree"), q.items("before"), q.items("after")) == want
    assert q.value("two") == 8 and q.source_text() == p.source_text()


def test_overflow_costs_its_grounding_alone(spark):
    top = 2**63 - 1
    p = Program(spark, f"""
        a(1) := {top}.  a(2) := 5.  a(3) := 0 - {top}.
        up(K) := a(K) + 1.  down(K) := a(K) - 2.  twice(K) := a(K) * 2.  cube(K) := a(K) ** 3.  far(K) := a(K) ** 3000000000.
        unit := 1 ** 3000000000.  sign := (0-1) ** 3000000001.  sum += {top}.  sum += 1.  fine += 2.  product *= {top}.  product *= 3.
        :- backchain next/1.  next(X) = X + 1.  called(K) := next(a(K)).""")  # fmt: skip
    assert p.items("up") == {(2,): 6, (3,): 1 - top} and p.items("down") == {(1,): top - 2, (2,): 3}
    assert p.items("twice") == {(2,): 10} and p.items("cube") == {(2,): 125} and p.items("far") == {}
    assert (p.value("unit"), p.value("sign"), p.value("sum"), p.value("fine"), p.value("product")) == (1, -1, None, 2, None)
    assert p.items("called") == {(2,): 6, (3,): 1 - top}
    assert sum("OverflowError" in r.message for r in p.errors().collect()) >= 7


def test_strings_repeat(spark):
    p = Program(spark, 'x(N) := "ab" * N for N in [0,1,3].  y := 2 * "-".  z := "a" * 99999999999.  w(T) := T * 2 for T in ["q",4,[1]].')
    assert p.items("x") == {(0,): "", (1,): "ab", (3,): "ababab"} and p.value("y") == "--" and p.value("z") is None
    assert p.items("w") == {("q",): "qq", (4,): 8}


def test_inserts_keep_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    p = Program(spark, "n += 1 for seen(K,_).")
    p.bind("seen", df, ["k", "s"], bag=True)
    before = p.relation("seen")
    for i in range(20):
        p.insert("seen", spark.createDataFrame([(i, "b")], "k int, s string"))
    assert p.value("n") == 21 and before.count() == 1
    plan = p.relation("seen")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Union") == 1 and len(p.sources["seen/2"].batches) < 10


def test_recursion_down_a_list_runs_without_python(spark):
    p = Program(spark, """
        :- backchain total/2.  total([], S) = S.  total([pair(_,X)|T], S) = total(T, S + X * 2).
        :- backchain back/2.   back([], L) = L.   back([pair(N,X)|T], L) = back(T, [&at(N,Y)|L]) for Y is mod(X, 7).
        all(U) bag= pair(N,X) for obs(U,N,X).
        sum(U) = total(all(U), 1).
        last(U) = back(all(U), [&at(0,0)]).""")  # fmt: skip
    rows = [(1, n, n * n) for n in range(1, 300)] + [(2, 1, 1 << 61), (2, 2, 1 << 61), (2, 3, 5), (3, 1, -4)]
    p.bind("obs", spark.createDataFrame(rows, "u long, n long, x long"), ["u", "n", "x"], unique=True)
    for name in ("sum", "last"):
        assert "Python" not in p.relation(name)._jdf.queryExecution().executedPlan().toString()
    assert p.items("sum") == {(1,): 1 + 2 * sum(n * n for n in range(1, 300)), (3,): -7}
    assert [r["message"] for r in p.errors().where("functor like 'sum/%'").collect()] == ["OverflowError: the result is no 64-bit integer"]
    got = {u[0]: [tuple(x.args) for x in v] for u, v in p.items("last").items()}
    assert got[1] == [(n, n * n % 7) for n in range(299, 0, -1)] + [(0, 0)] and got[3] == [(1, 3), (0, 0)]
