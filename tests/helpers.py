"""What several test modules share."""


def rows(df):
    return sorted(tuple(r) for r in df.collect())
