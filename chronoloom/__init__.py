"""chronoloom: a Spark-native engine for bi-temporal knowledge graphs and the text around them."""
