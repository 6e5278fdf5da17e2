import importlib

import __spark_entry__ as entry


def test_entry_names_and_flagship(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "exact_search" in names
    assert entry.entry(spark).count() > 0


def test_modules_that_lack_something_are_passed_over(tmp_path, monkeypatch, capsys):
    assert entry._optional("seqweave.no_such_module") is None
    (tmp_path / "broken_module.py").write_text("import module_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    importlib.invalidate_caches()
    assert entry._optional("broken_module") is None
    assert "module_that_is_not_there" in capsys.readouterr().err
