from parallaxa.operators.integrity import structural_mask


def test_structural_mask(spark):
    whole = [(c, l) for c in range(4) for l in range(6)]
    cases = {
        1: (whole, 0),
        2: (whole + [(9, 50), (9, 50)], 2 | 4 | 8),  # one camera that sees one landmark twice, far from the rest
        3: (whole + [(c + 10, l + 10) for c, l in whole], 8),
        4: ([(c, l) for c, l in whole if c or l < 2] * 3, 0),  # the anchor sees two landmarks
        5: ([(c, l) for c, l in whole if c != 3 or l < 2] * 3, 4),
        6: ([(0, 0)], 2),  # the anchor alone, 2 equations for 2
    }
    rows = [(g, c, l) for g, (edges, _) in cases.items() for c, l in edges] + [(1, None, 5), (None, 1, 1)]
    got = structural_mask(spark.createDataFrame(rows, "g bigint, c bigint, l bigint"), "g", "c", "l").collect()
    assert {r.g: r.mask for r in got} == {g: mask for g, (_, mask) in cases.items()}
    assert {r.g: (r.cameras, r.landmarks, r.observations) for r in got}[2] == (5, 7, 26)
