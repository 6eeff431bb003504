"""gridloom: interval-demand analytics as lazy Spark plans."""
