"""States parsed column by column against the same steps inside one expression."""

from pyspark.sql import functions as F

from logloom.functions import states as S
from logloom.operators import states

LINES = [
    "0: R1=ctx() R10=fp0", "3: (b7) r1 = 0 ; R1_w=P7 R2=scalar(smin=-5,umax=0xff,var_off=(0x0; 0xff)) R2=inv(id=3)", "from 3 to 7: R3=scalar(map=a(b(c(d))),id=4) fp-8=mmmm0000 R4=99999999999999999999",
    "frame1: no", "7: frame2: R5_w=map_value(off=-8,ks=4,vs=16) R6=18446744073709551616 R7=-1", "plain text", "",
]


def test_register_states_as_in_one_expression(spark):
    lines = spark.createDataFrame([(0, k, x) for k, x in enumerate(LINES)], "log_id int, line_no int, line string")
    found = states.states(lines)
    whole = lines.select("log_id", F.col("line_no").alias("log_line"), S.state(F.col("line")).alias("s")).where("s is not null").select("log_id", "log_line", "s.*")
    assert sorted(found.collect(), key=str) == sorted(whole.collect(), key=str) and found.count() == 4
    rows = states.register_states(found)
    inside = whole.select("log_id", "log_line", "pc", "frame", "kind", F.explode(S.registers(F.col("tokens"))).alias("r")).select("log_id", "log_line", "pc", "frame", "kind", "r.reg", "r.state.*")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, inside.select(*rows.columns).collect()), key=str)
    assert [r.id for r in found.select(S.state_of(F.col("tokens"), F.lit(3))["id"].alias("id")).collect() if r.id] == [4]
