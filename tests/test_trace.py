from codeloom.sources import trace


def test_parse(spark):
    lines = [
        "CALL THREADID 0 CALLERNAME main CALLEENAME f INVNO 1 ARGS NONE STATICCALL [ f(a, b) ] INSLOC m.c:3 TS 0_1_7",
        "READ THREADID 1 FUNCNAME f VARNAME x OFFSET 0x10 TS 0_1_8",
        "LOCK TID 2 ADDRESS 0xff TYPE MUTEX TS 0_1_9",
        "",
        "END",
    ]
    rows = trace.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.rectype, r.run, r.seq, r.thread, r.offset) for r in rows] == [("CALL", "0_1", 7, "0", None), ("READ", "0_1", 8, "1", "0x10"), ("LOCK", "0_1", 9, "2", None), ("END", None, None, None, None)]
    assert rows[0].attrs["STATICCALL"] == "[ f(a, b) ]" and rows[0].attrs["INSLOC"] == "m.c:3" and rows[3].attrs == {}
