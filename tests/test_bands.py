def test_state_outlives_a_restart(spark, tmp_path):
    from tessera.streaming.bands import in_order

    batch = lambda *rows: spark.createDataFrame([(r, 10 * r) for r in rows], "row long, at long")
    place, got = f"file://{tmp_path}/bands/next.json", []
    first = in_order(lambda row, at: got.append((row, at)), state=place)
    first(batch(0, 2, 4), 0)
    again = in_order(lambda row, at: got.append((row, at)), state=place)
    again(batch(0, 2, 4), 0)  # run once more after it was kept
    again(batch(1), 1)
    again(batch(3, 3), 2)
    third = in_order(lambda row, at: got.append((row, at)), state=place)
    third(batch(2, 5), 3)
    assert got == [(i, 10 * i) for i in range(6)]
    lost = in_order(lambda row, at: got.append(row), first=7)
    lost(batch(8), 0)
    lost(batch(7), 1)
    assert got[6:] == [7, 8]
