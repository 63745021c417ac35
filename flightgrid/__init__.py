"""PySpark-native analytics for aerial image surveys and the tables around them."""
