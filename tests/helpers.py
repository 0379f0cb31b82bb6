"""What the core tests share besides fixtures."""

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    """Rows of a frame as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
