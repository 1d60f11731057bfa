import sys

import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
    for n in (1, 5):
        assert any(k.startswith(f"p{n}_") for k in q)
    assert entry.entry(spark).columns == ["src", "line_no", "triple_ix", "role"]


def test_core_does_not_import_llm():
    import subprocess

    code = "import sys; sys.modules['passagekg.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('p2_') for k in e.queries()) and 'p1_found' in e.queries(); assert not [m for m in sys.modules if m.startswith('passagekg.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
