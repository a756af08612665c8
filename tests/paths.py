"""Where the tests find the given tables."""

DATA = "/root/testdata/sf0.001"
