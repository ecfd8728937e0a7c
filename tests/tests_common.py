"""Small rasters for tests."""


def pixels_of(spark, grid):
    width = len(grid[0])
    rows = [(y * width + x, x, y, [float(b) for b in (v if isinstance(v, (list, tuple)) else [v])]) for y, row in enumerate(grid) for x, v in enumerate(row) if v is not None]
    return spark.createDataFrame(rows, "pix long, x int, y int, bands array<double>")
