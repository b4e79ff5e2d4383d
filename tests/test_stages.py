"""All five stages, from a count table to weights."""

import pytest

from loomgraph import __main__ as cli
from loomgraph.plans import stages
from loomgraph.sources import xlsx
from loomgraph.sources.bands import BANDS


def test_end_to_end(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    names = [b[0] for b in BANDS]
    head = "SIC," + ",".join(f'"{n}"' for n in names)
    body = "\n".join(f"{s}," + ",".join(str(v) for v in [0, 0, 0, 12, 9, 6] + [0] * 12) for s in (11, 22, 33))
    (tmp_path / "FIRM.csv").write_text(head + "\n" + body + "\n")
    assert stages.sample(spark, p("FIRM.csv"), p("MAPPING.xlsx"), p("STRENGTH.xlsx"), "60", seed=1) == 60
    assert xlsx.read_table(spark, p("MAPPING.xlsx")).columns == ["Firm_ID", "SIC"]
    matrix = "x,11,22,33\n11,0.5,0.2,0.3\n22,0.2,0.5,0.3\n33,0.3,0.3,0.4\n"
    (tmp_path / "IOT.csv").write_text(matrix)
    (tmp_path / "Sij.csv").write_text(matrix)
    par, violated = stages.fit(spark, p("MAPPING.xlsx"), p("STRENGTH.xlsx"), p("IOT.csv"), p("Sij.csv"), p("edges"), mean_degree=6.0)
    assert par.z > 0 and violated >= 0
    n = spark.read.text(p("edges")).count()
    assert 260 < n < 460
    before, after = stages.make_irreducible(spark, p("edges"), p("STRENGTH.xlsx"), p("MAPPING.xlsx"), p("IOT.csv"), p("more"), report_out=p("report"))
    assert before >= 1 and after == 1
    report = {r["name"]: r["value"] for r in spark.read.csv(p("report"), header=True).collect()}
    assert report["components_before"] == str(before) and report["self_loops"] == "60"
    assert before == 1 or (float(report["lower_bound"]) <= float(report["objective"]) and report["edges_added"] == report["to_keep"])
    done = stages.weight_inputs(spark, p("more"), p("STRENGTH.xlsx"), p("MAPPING.xlsx"), p("network"), p("money"), p("sector"))
    assert len(done) == 3 and len(stages.weight_inputs(spark, p("none"), p("none"), p("none"), p("a"), p("b"), p("c"))) == 0
    left = stages.solve_weights(spark, p("network"), p("money"), p("sector"), p("weights"), firm_rel=0.95, sector_rel=0.8, cycles=12)
    assert left["row_miss"] < 0.05
    assert spark.read.csv(p("weights"), header=True).count() == spark.read.text(p("more")).distinct().count()
    with pytest.raises(FileNotFoundError):
        stages.sample(spark, p("none.csv"), p("a"), p("b"))


def test_command_line():
    a = vars(cli.parser().parse_args("irreducible --edges e --strength s --mapping m --iot i --edges-out o --flip-input --theta 0.1".split()))
    assert a["flip_input"] and a["theta"] == 0.1 and not a["normalize_q"] and a["seed"] == 12345
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["weights"])


def test_unknown_options(capsys):
    given = "--edges e --strength s --mapping m --iot i --edges-out o --colour blue".split()
    assert cli.options(["irreducible", *given])["edges"] == "e"
    assert "--colour" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.options("inputs --edges e --strength s --mapping m --network-out n --money-out o --sector-out p --colour blue".split())


def test_a_report_has_no_default():
    from loomgraph import __main__ as command

    files = [x for n in ("mapping", "strength", "iot", "sij", "edges-out") for x in (f"--{n}", "x")]
    assert "report_out" not in command.options(["fit", *files])
    assert command.options(["fit", *files, "--report-out", "r"])["report_out"] == "r"
