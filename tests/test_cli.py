from tidemark import cli


def test_commands(spark, tmp_path):
    said = []

    def run(*args):
        said.clear()
        code = cli.run(spark, cli.parser().parse_args(["--path", str(tmp_path), *args]), said.append)
        return code, list(said)

    assert run("set", "a", "1") == (0, [])
    assert run("batch-set", "b", "c", "2", "3") == (0, [])
    assert run("batch-set", "b", "c", "2")[0] == 2
    assert run("get", "b") == (0, ["2"]) and run("get", "x")[0] == 1
    assert run("batch-get", "c", "x") == (0, ["c\t3", "x\t"])
    assert run("batch-remove", "c", "x") == (0, ["not removed: x"])
    assert run("flush") == (0, []) and run("len") == (0, [3])  # one row a key after a flush
    assert run("scan", "--low", "b") == (0, ["b\t2"])
    assert run("describe")[1][0].startswith("level 0")
