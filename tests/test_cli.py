import io
import os

import pytest

from textloom import cli, errors


@pytest.fixture
def run(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)

    def go(*args, stdin=b"", rc=None):
        if rc is not None:
            monkeypatch.setenv("TEXTLOOMRC", rc)
        out, err = io.BytesIO(), io.StringIO()
        code = cli.main(list(args), spark=spark, stdin=io.BytesIO(stdin), stdout=out, stderr=err)
        return code, out.getvalue().decode(), err.getvalue()

    return go


@pytest.fixture
def sample(tmp_path):
    (tmp_path / "s.csv").write_text("name,value1,value2\na,1,0\nb,2,2\nc,,0\n")
    return "s.csv"


def test_basic(run, sample):
    assert run("-H", "-d,", "select name, value1 from s.csv")[:2] == (0, "a,1\nb,2\nc,\n")
    assert run("-H", "-d,", "-O", "select avg(value1) m from s.csv")[:2] == (0, "m\n1.5\n")
    assert run("-H", "-d,", "-T", "select name, value2 from s.csv where value2 > 0")[1] == "b\t2\n"
    assert run("-H", "-d,", "-D;", "select * from s.csv limit 1")[1] == "a;1;0\n"


def test_stdin_and_many_queries(run):
    assert run("select sum(c1) from -", "select count(*) from -", stdin=b"1\n2\n")[:2] == (0, "3\n2\n")


def test_analyze(run, sample):
    code, out, _ = run("-H", "-d,", "-A", "select * from s.csv")
    assert code == 0
    assert out.splitlines() == ["Table: s.csv", "  Sources:", f"    source_type: file source: {os.path.realpath(sample)}", "  Fields:", "    `name` - text", "    `value1` - int", "    `value2` - int"]


def test_header_warning(run, sample):
    code, _, err = run("-d,", "select * from s.csv")
    assert code == 0
    assert "header" in err


def test_quoting_modes(run, tmp_path):
    (tmp_path / "q").write_text('"quoted data" 23\nplain "a ""b"""\n')
    assert run("select * from q")[1] == '"quoted data" 23\nplain "a ""b"""\n'
    assert run("-W", "none", "select c1 from q")[1] == "quoted data\nplain\n"
    assert run("-W", "all", "select 1 a, 'x' b")[1] == '"1" "x"\n'
    assert run("-W", "nonnumeric", "select 1 a, 'x' b")[1] == '1 "x"\n'
    assert run("-w", "none", "select c1 from q")[1] == '"""quoted"\nplain\n'


def test_formats(run, sample):
    assert run("-f", "1={:05.1f},2={:d}", "select 1.25 a, 7 b")[1] == "001.2 7\n"
    assert run("-b", "-O", "-H", "-d,", "select name, value1 from s.csv where value1 is not null")[1] == "name,value1\na   ,1     \nb   ,2     \n"
    assert run("-f", "1={:d}", "select 'x' a")[0] == errors.FORMAT


@pytest.mark.parametrize(
    ("args", "code"),
    [
        (("-d", "ab", "select 1"), errors.DELIMITER),
        (("-e", "nope", "select 1"), errors.UNKNOWN_ENCODING),
        (("-m", "loose", "select 1"), errors.PARSING_MODE),
        (("-w", "some", "select 1"), errors.INPUT_QUOTING),
        (("-W", "some", "select 1"), errors.OUTPUT_QUOTING),
        (("-M", "2", "select 1"), errors.FIELD_SIZE),
        (("-M", "x", "select 1"), errors.FIELD_SIZE),
        (("-c", "0", "select 1"), errors.COLUMN_RANGE),
        (("-C", "always", "select 1"), errors.TABLE_MISSING),
        (("--max-attached-sqlite-databases", "3", "select 1"), errors.ATTACH_LIMIT),
        (("-S", "x.db", "-A", "select 1"), errors.SAVE_WITH_ANALYZE),
        (("-E", "nope", "select 1"), errors.OUTPUT_STREAM),
        (("-E", "ascii", "select 'ñ' x"), errors.ENCODE),
        (("-q", "missing.sql"), errors.SQL),
        ((), errors.SQL),
        (("select * from missing.txt",), errors.FILE_MISSING),
        (("select * from",), errors.NO_TABLE),
        (("--no-such-option", "select 1"), errors.SQL),
    ],
)
def test_exit_codes(run, args, code):
    assert run(*args)[0] == code


def test_query_file(run, tmp_path):
    (tmp_path / "q.sql").write_bytes("select 'ñ' x".encode("latin-1"))
    assert run("-q", "q.sql", "-Q", "latin-1")[1] == "ñ\n"
    assert run("-q", "q.sql")[0] == errors.ENCODE
    assert run("-q", "q.sql", "select 1")[0] == errors.SQL


def test_config(run, tmp_path, sample):
    (tmp_path / "rc").write_text("[options]\ndelimiter=,\nheader=true\noutput_header=true\n")
    assert run("select name from s.csv limit 1", rc=str(tmp_path / "rc"))[1] == "name\na\n"
    assert run("select 1", rc=str(tmp_path / "gone"))[0] == errors.RC_MISSING
    (tmp_path / "bad").write_text("[options]\nheader=maybe\n")
    assert run("select 1", rc=str(tmp_path / "bad"))[0] == errors.OTHER
    code, out, _ = run("--dump-defaults", rc="None")
    assert code == 0
    assert out.startswith("[options]\n")


def test_listing_and_version(run):
    assert "percentile" in run("-L")[1]
    assert run("-v")[0] == 0


def test_save_and_read_back(run, sample):
    assert run("-H", "-d,", "-S", "o.sqlite", "select * from s.csv")[0] == 0
    assert run("select sum(value2) from o.sqlite:::s_dot_csv")[1] == "2\n"
    assert run("-S", "o.sqlite", "select 1")[0] == errors.TARGET_EXISTS


def test_overrides_warn(run, tmp_path):
    (tmp_path / "t").write_text("a\tb\n")
    code, out, err = run("-t", "-d,", "select c2 from t")
    assert (code, out) == (0, "b\n")
    assert "overrides" in err
