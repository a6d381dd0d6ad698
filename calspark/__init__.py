"""Calendar, timetable and reminder analytics on Spark DataFrames and streams."""
