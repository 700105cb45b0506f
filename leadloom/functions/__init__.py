"""leadloom.functions"""
