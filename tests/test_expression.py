import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantaloom.generate import candidates, combiner_features, engineered
from quantaloom.operators import OPERATORS, operator_names
from quantaloom.plans.compiler import Stages, lower
from quantaloom.plans.expression import Call, Field, FormulaError, Number, depth, fields, parse, resolve, show, validate

BAD = ["close -1", "5-3", "1e5", "foo(close)", "ts_mean(close)", "ts_corr(close, 5)", "cs_rank(close, open)", "(close", "", "   ", "close +", "close $ 2", ".5", "ts_mean(close, volume)", "close close"]


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    ok, why = validate(text)
    assert not ok and why


def test_precedence_and_association():
    assert show(parse("close - 1")) == "sub(close, 1)"
    assert show(parse("a-b-c")) == "sub(sub(a, b), c)"
    assert show(parse("a+b*c/d")) == "add(a, div(mul(b, c), d))"
    assert show(parse("-a*-2")) == "mul(neg(a), -2)"
    assert show(parse("--a")) == "neg(neg(a))"


def test_depth_limit():
    text = "close"
    for _ in range(19):
        text = f"abs({text})"
    assert validate(text)[0]
    assert not validate(f"abs({text})")[0]
    assert not validate("(" * 5000 + "close" + ")" * 5000)[0]


def test_windows_fold_and_clamp():
    assert resolve(parse("ts_mean(close, 5+5)")).args[1] == Number(10.0)
    assert resolve(parse("ts_lag(close, 1)")).args[1] == Number(2.0)
    assert resolve(parse("ts_mean(close, 120)"), n_dates=30).args[1] == Number(30.0)
    assert resolve(parse("power(close, 7/2)")).args[1].value == pytest.approx(3.5)


def test_fields():
    assert fields(parse("ts_corr(close, volume / open, 5)")) == {"close", "volume", "open"}
    assert validate("close", {"close"})[0] and not validate("pe", {"close"})[0]


def test_operator_names():
    names = [n for n in operator_names()]
    assert len(names) == 35 and len([n for n in names if n.startswith("ts_")]) == 18


nodes = st.recursive(
    st.sampled_from(["open", "close", "volume"]).map(Field) | st.integers(-9, 99).map(lambda x: Number(float(x))),
    lambda inner: st.tuples(st.sampled_from(["add", "mul", "max"]), inner, inner).map(lambda x: Call(x[0], x[1:])) | inner.map(lambda x: Call("cs_rank", (x,))),
    max_leaves=8,
)


@settings(max_examples=200, deadline=None)
@given(nodes)
def test_round_trip(node):
    assert parse(show(node)) == node and depth(node) >= 1


def test_stages_follow_alternations():
    s = Stages()
    tree = lower(resolve(parse("cs_rank(ts_mean(cs_zscore(ts_std(returns, 5)), 10)) + ts_mean(ts_std(returns, 5), 3)")))
    s.place(tree)
    found = {show(n)[:8]: at for n, at in s.at.items() if isinstance(n, Call)}
    assert [len(v) for v in s.windows().values()] == [1, 1, 1, 1, 1]
    assert s.at[tree][0] == 3 and found["ts_std(r"] == (0, 0)
    assert set(s.windows()) == {(0, 0), (0, 1), (1, 0), (2, 0), (3, 0)}


def test_counts():
    assert [len(candidates(k)) for k in (1, 2, 3)] == [864, 15152, 22093]
    every = candidates(3, True)
    assert len(every) == 22110 and every == sorted(set(every))
    assert all(validate(f)[0] for f in every[::97])
    assert len(engineered(1000)) == 188 and len(combiner_features(1000)) == 31
    assert len(engineered(1000, ("total_mv", "pe", "pb", "dv_ttm", "bvps", "roe_pct", "basic_eps"))) == 204
    assert "ret_60d" not in engineered(50)


def test_errors_are_told_apart():
    with pytest.raises(FormulaError, match="Unknown operator"):
        resolve(parse("foo(close)"))
    with pytest.raises(FormulaError, match="Unknown field"):
        resolve(parse("nothing"), {"close"})
    with pytest.raises(FormulaError, match="expects"):
        resolve(parse("ts_mean(close)"))
    assert OPERATORS["ts_corr"].arrays == 2
