"""tessera: Spark-native building, labelling, splitting and checking of large text datasets."""
