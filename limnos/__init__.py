"""Water-observation analytics as Spark plans over keyed tables of many stations at once."""
