"""Named queries over the test tables, and lazy graphs of operators."""
