"""What several test files share: the tables' folder and the rows of a frame."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
