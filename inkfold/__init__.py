"""inkfold: page, region and text analytics as PySpark DataFrame transforms."""
