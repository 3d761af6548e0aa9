"""End-to-end plans: the pipeline, the test views and the registered queries."""
