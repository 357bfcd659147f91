"""Dictionary- and rule-based entity recognition over multi-script text, built on Spark SQL."""
