import numpy as np
import pytest

from vicinal.config import GraphConfig, SplitConfig, StudyConfig
from vicinal.sources.records import Record, array_sha256, file_sha256, load_records, save_record, seeded


def test_round_trip_and_unknown_keys(tmp_path):
    c = StudyConfig(graph=GraphConfig(name="bbknn", k=2), seeds=(1, 2))
    for name in ("c.yaml", "c.json"):
        c.save(tmp_path / name)
        assert StudyConfig.load(tmp_path / name) == c and StudyConfig.load(tmp_path / name).sha256() == c.sha256()
    with pytest.raises(ValueError, match="unknown settings in GraphConfig: kk"):
        StudyConfig.of({"graph": {"kk": 1}})
    with pytest.raises(FileNotFoundError):
        StudyConfig.load(tmp_path / "none.yaml")


def test_ranges():
    for bad in ({"train": 0.95}, {"train": 0.5, "val": 0.2, "test": 0.2}, {"kind": "custom"}):
        with pytest.raises(ValueError):
            SplitConfig.of(bad)
    with pytest.raises(ValueError):
        GraphConfig(k=101)


def test_records(tmp_path):
    save_record(tmp_path, Record("b", {"k": 1}, {"f1": 0.12345678}, {"x": "y"}))
    save_record(tmp_path, Record("a", metrics={"f1": 1.0}).failed(ValueError("no")))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "record.json").write_text("{")
    got = load_records(tmp_path)
    assert [r.run_id for r in got] == ["a", "b"] and got[0].metrics == {"f1": None} and got[0].failure["error_type"] == "ValueError"
    assert (tmp_path / "b" / "metrics" / "f1").read_text() == "0.123457"
    assert file_sha256(tmp_path / "b" / "params" / "k") == "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"


def test_hashes_and_seeds():
    a = np.arange(6).reshape(2, 3)
    assert array_sha256(a) == array_sha256(np.asfortranarray(a)) != array_sha256(a.reshape(3, 2))
    before = np.random.get_state()[1][0]
    with seeded(5) as one:
        x = one.random(), np.random.random()
    with seeded(5) as two:
        assert (two.random(), np.random.random()) == x
    assert np.random.get_state()[1][0] == before
