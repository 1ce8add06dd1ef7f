"""kinname: approximate person-name search and corpus operators as Spark plans."""
