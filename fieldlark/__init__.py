"""fieldlark: radio-channel sensing analytics as Spark DataFrame operators."""
