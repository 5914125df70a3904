"""Studies (rules as data) and the feature plans built from them."""
