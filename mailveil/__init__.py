"""Mail privacy masking as Spark column expressions, joins and windows."""
